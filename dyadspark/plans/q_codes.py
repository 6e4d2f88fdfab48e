"""Crosswalks, corrections and joins."""

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import aggregates as A
from dyadspark.operators import codes as K
from dyadspark.operators import dyads as D
from dyadspark.operators import joins as J
from dyadspark.plans import base as B
from dyadspark.plans.registry import query
from dyadspark.session import stored

GOODS = [("widget|gadget", "WID"), ("gizmo", "GIZ"), ("bolt|screw", "BLT"), ("^small", "SML"), ("ring", "RNG")]


@query(
    "crosswalk_exact",
    """SELECT c_custkey, c_nationkey, CASE c_nationkey WHEN 3 THEN 'OVER_3' WHEN 4 THEN 'OVER_4' ELSE n_name END AS code
      FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 4""",
)
def crosswalk_exact(t):
    walk = t.nation.where(F.col("n_regionkey") != 4)
    coded = K.recode(t.customer, "c_nationkey", walk, "n_nationkey", "n_name", "code", {3: "OVER_3", 4: "OVER_4"})
    return coded.select("c_custkey", "c_nationkey", "code")


@query(
    "crosswalk_regex",
    """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'RED' WHEN regexp_matches(lower(p_name), 'widget|gadget') THEN 'WID'
      WHEN regexp_matches(lower(p_name), 'gizmo') THEN 'GIZ' WHEN regexp_matches(lower(p_name), 'bolt|screw') THEN 'BLT'
      WHEN regexp_matches(lower(p_name), '^small') THEN 'SML' WHEN regexp_matches(lower(p_name), 'ring') THEN 'RNG' END AS code FROM part""",
)
def crosswalk_regex(t):
    return K.recode_name(t.part, "p_name", GOODS, "code", {"red widget": "RED"}).select("p_partkey", "code")


@query(
    "enrich_both_ends",
    "WITH " + B.FLOWS_SQL + """ SELECT state1, state2, year, n, a.n_name AS name1, a.n_regionkey AS region1, b.n_name AS name2,
      b.n_regionkey AS region2 FROM flows JOIN nation a ON a.n_nationkey = state1 JOIN nation b ON b.n_nationkey = state2""",
)
def enrich_both_ends(t):
    pairs = B.flows(t).select("state1", "state2", "year", "n")
    return D.add_both_ends(pairs, t.nation, "n_nationkey", {"n_name": "name", "n_regionkey": "region"})


@query("crosswalk_unmatched", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def crosswalk_unmatched(t):
    return K.unmatched(t.events, "user_id", t.supplier, "s_suppkey")


def _mentions_sql(name: str, words: list[str]) -> str:
    """Words by place: texts are cut at every word, places follow from the lengths of the cuts, the longest word of a place stays."""
    return f"""{name}_w AS (SELECT unnest({words}) AS w),
{name}_u AS (SELECT doc_id, w, unnest(string_split(lower(text), w)) AS piece, generate_subscripts(string_split(lower(text), w), 1) AS k,
  len(string_split(lower(text), w)) AS cuts FROM documents, {name}_w),
{name}_p AS (SELECT doc_id, w, k, cuts, sum(length(piece) + length(w)) OVER (PARTITION BY doc_id, w ORDER BY k) - length(w) AS place FROM {name}_u),
{name}_b AS (SELECT doc_id, place, arg_max(w, length(w)) AS w FROM {name}_p WHERE k < cuts GROUP BY ALL),
{name} AS (SELECT doc_id, count(*) AS n, string_agg(w, ',' ORDER BY place) AS found FROM {name}_b GROUP BY 1)"""


WORDS = ["ment", "tion", "heit", "mente", "ung", "entend", "tun"]


@query("mentions_all", f"WITH {_mentions_sql('m', WORDS)} SELECT doc_id, coalesce(n, 0) AS n, coalesce(found, '') AS found FROM documents LEFT JOIN m USING (doc_id)")
def mentions_all(t):
    """Among the words are one that begins with another one and some that overlap others."""
    found = t.documents.select("doc_id", K.mentions("text", WORDS).alias("m"))
    return found.select("doc_id", F.size("m").cast("bigint").alias("n"), F.array_join("m", ",").alias("found"))


@query(
    "mentions_fallback",
    f"""WITH {_mentions_sql('a', ['ment', 'heit'])}, {_mentions_sql('b', ['tion', 'ung'])}
    SELECT doc_id, coalesce(CASE WHEN coalesce(a.n, 0) < b.n THEN b.found ELSE a.found END, '') AS found
    FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
)
def mentions_fallback(t):
    a, b = K.mentions("text", ["ment", "heit"]), K.mentions("text", ["tion", "ung"])
    return t.documents.select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", F.array_join(K.longer_list("a", "b"), ",").alias("found"))


@query(
    "patch_keyed",
    """SELECT c_custkey, CASE c_custkey WHEN 1 THEN 1600.0 WHEN 7 THEN NULL ELSE c_acctbal END AS c_acctbal,
      CASE c_custkey WHEN 1 THEN 'FIXED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def patch_keyed(t):
    patches = [{"c_custkey": 1, "c_acctbal": 1600.0, "c_mktsegment": "FIXED"}, {"c_custkey": 7, "c_acctbal": None}]
    return K.patch_keyed(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), patches, ["c_custkey"])


@query(
    "patch_null",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'X' ELSE nullif(o_orderstatus, 'P') END AS status
      FROM orders""",
)
def patch_null(t):
    sparse = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderpriority")
    return K.fill_where(sparse, "status", F.col("o_orderpriority") == "5-LOW", "X").drop("o_orderpriority")


@query(
    "lookup_first",
    """SELECT s_suppkey, c_custkey AS first_customer, c_mktsegment AS segment FROM supplier LEFT JOIN (SELECT * FROM customer
      QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) ON c_nationkey = s_nationkey""",
)
def lookup_first(t):
    attrs = {"c_custkey": "first_customer", "c_mktsegment": "segment"}
    looked = K.lookup_first(t.supplier, "s_nationkey", t.customer, "c_nationkey", attrs, [F.asc("c_custkey")])
    return looked.select("s_suppkey", "first_customer", "segment")


@query(
    "join_left_natural",
    """SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def join_left_natural(t):
    return J.natural_left(t.documents.select("doc_id", "source"), t.labels)


@query(
    "join_left_on",
    """WITH s AS (SELECT s_nationkey AS state, count(*) AS n_supp FROM supplier GROUP BY 1)
    SELECT c_custkey, c_nationkey, n_supp FROM customer LEFT JOIN s ON state = c_nationkey""",
)
def join_left_on(t):
    supp = A.count_by(t.supplier.withColumnRenamed("s_nationkey", "state"), "state", name="n_supp")
    return J.left_on(t.customer.select("c_custkey", "c_nationkey"), supp, {"c_nationkey": "state"})


@query(
    "join_full",
    """WITH a AS (SELECT c_nationkey AS state, count(*) AS n_rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
    b AS (SELECT s_nationkey AS state, count(*) AS n_supp FROM supplier GROUP BY 1)
    SELECT coalesce(a.state, b.state) AS state, n_rich, n_supp FROM a FULL JOIN b ON a.state = b.state""",
)
def join_full(t):
    rich = t.customer.where(F.col("c_acctbal") > 9000).withColumnRenamed("c_nationkey", "state")
    supp = t.supplier.withColumnRenamed("s_nationkey", "state")
    return J.full_on(A.count_by(rich, "state", name="n_rich"), A.count_by(supp, "state", name="n_supp"), ["state"])


@query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def join_semi(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "join_anti",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def join_anti(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query(
    "join_reverse_dyad",
    "WITH " + B.DYADS_SQL + """ SELECT d.state1, d.state2, d.typology AS state1_typology, r.typology AS state2_typology FROM dyads d
      LEFT JOIN dyads r ON r.state1 = d.state2 AND r.state2 = d.state1""",
)
def join_reverse_dyad(t):
    both = D.add_partner_value(B.dyads(t), "typology", "state2_typology")
    return both.withColumnRenamed("typology", "state1_typology")


@query(
    "join_cross",
    """SELECT c_custkey, l.v AS priority FROM customer, (SELECT DISTINCT o_orderpriority AS v FROM orders) l""",
)
def join_cross(t):
    return J.expand_grid(t.customer.select("c_custkey"), priority=J.levels_of(t.orders, "o_orderpriority"))


PANEL_SQL = """
obs AS (SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL),
panel AS (SELECT k.user_id, k.event_type, d.day, coalesce(n, 0) AS n, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT user_id, event_type FROM obs) k, (SELECT DISTINCT day FROM obs) d
  LEFT JOIN obs o ON o.user_id = k.user_id AND o.event_type = k.event_type AND o.day = d.day)"""


def incident_days(t):
    return t.events.groupBy("user_id", "event_type", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query("panel_complete", "WITH " + PANEL_SQL + " SELECT * FROM panel")
def panel_complete(t):
    return J.complete_panel(incident_days(t), ["user_id", "event_type"], "day", {"n": 0, "total": 0.0})


@query(
    "join_reduce",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS n_high, nullif(count(*) FILTER
      (o_orderstatus = 'F'), 0) AS n_done FROM orders GROUP BY 1""",
)
def join_reduce(t):
    parts = [
        A.count_by(t.orders, "o_orderpriority"),
        A.count_by(t.orders.where(F.col("o_totalprice") > 250000), "o_orderpriority", name="n_high"),
        A.count_by(t.orders.where(F.col("o_orderstatus") == "F"), "o_orderpriority", name="n_done"),
    ]
    return J.join_all(parts, ["o_orderpriority"])


@query(
    "join_grand_mean",
    """WITH g AS (SELECT event_type, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, avg(value) AS m FROM events GROUP BY ALL)
    SELECT event_type, year, month, round(m, 4) AS mean, round((SELECT avg(value) FROM events e WHERE e.event_type = g.event_type), 4)
      AS grand_mean FROM g""",
)
def join_grand_mean(t):
    # the grand mean follows from the monthly sums, so the events are read once
    monthly = stored(
        t.events.groupBy("event_type", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(
            F.sum("value").alias("s"), F.count("value").alias("n")
        )
    )
    grand = monthly.groupBy("event_type").agg(F.round(N.safe_div(F.sum("s"), F.sum("n")), 4).alias("grand_mean"))
    mean = F.round(N.safe_div("s", "n"), 4).alias("mean")
    return J.left_on(monthly.select("event_type", "year", "month", mean), grand.withColumnRenamed("event_type", "g"), {"event_type": "g"})


@query(
    "join_fill",
    """SELECT c_custkey, coalesce(n, 0) AS n_orders, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS has_orders FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def join_fill(t):
    n = A.count_by(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", name="n_orders")
    filled = J.left_fill(t.customer.select("c_custkey"), n, ["c_custkey"], {"n_orders": 0})
    return filled.withColumn("has_orders", (F.col("n_orders") > 0).cast("int"))
