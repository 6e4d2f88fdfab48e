"""Grouped aggregation."""

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import aggregates as A
from dyadspark.operators import ordered as O
from dyadspark.plans import base as B
from dyadspark.plans.registry import query

PARTS = ["p_size", "p_retailprice"]
STATS = ["mean", "sd", "median", "min", "max", "obs"]


@query(
    "agg_count",
    "SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY ALL",
)
def agg_count(t):
    return A.count_by(t.lineitem.withColumn("year", F.year("l_shipdate")), "l_returnflag", "l_linestatus", "year")


@query(
    "agg_sum_narm",
    """SELECT l_suppkey, CAST(coalesce(sum(CASE WHEN l_discount > 0.09 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0)
      AS DOUBLE) AS total FROM lineitem GROUP BY 1""",
)
def agg_sum_narm(t):
    some = t.lineitem.select("l_suppkey", F.when(F.col("l_discount") > 0.09, N.money("l_extendedprice")).alias("v"))
    return some.groupBy("l_suppkey").agg(N.sum0("v").cast("double").alias("total"))


@query(
    "agg_sum_strict",
    """SELECT l_orderkey, CAST(CASE WHEN count(v) = count(*) THEN sum(v) END AS DOUBLE) AS total
      FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS v FROM lineitem)
      GROUP BY 1""",
)
def agg_sum_strict(t):
    some = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") != "N", N.money("l_extendedprice")).alias("v"))
    return some.groupBy("l_orderkey").agg(N.sum_strict("v").cast("double").alias("total"))


@query(
    "agg_stats",
    """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 3) AS sd,
      round(median(l_extendedprice), 4) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS obs
      FROM lineitem GROUP BY 1""",
)
def agg_stats(t):
    from dyadspark.operators.quantiles import describe_long

    s = describe_long(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return s.select(
        "l_returnflag", F.round("mean", 4).alias("mean"), F.round("sd", 3).alias("sd"), F.round("median", 4).alias("median"),
        "min", "max", "obs",
    )


@query(
    "agg_obs",
    "SELECT source, count(quality) AS obs, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
)
def agg_obs(t):
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("quality").alias("obs"), F.count(F.lit(1)).alias("n"))


def _wide_sql(c):
    return f"""round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_sd, CAST(median({c}) AS DOUBLE) AS {c}_median,
      CAST(min({c}) AS DOUBLE) AS {c}_min, CAST(max({c}) AS DOUBLE) AS {c}_max, count({c}) AS {c}_obs"""


def _tidy_sql(c):
    return f"""SELECT '{c}' AS variable, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd,
      CAST(median({c}) AS DOUBLE) AS median, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
      CAST(count({c}) AS DOUBLE) AS obs FROM part"""


@query("describe_wide", f"SELECT {', '.join(_wide_sql(c) for c in PARTS)} FROM part")
def describe_wide(t):
    wide = A.describe_wide(t.part, PARTS, STATS)
    return wide.withColumns({c: F.round(c, 4) for c in wide.columns if c.endswith(("_mean", "_sd"))})


@query("describe_tidy", " UNION ALL ".join(_tidy_sql(c) for c in PARTS))
def describe_tidy(t):
    wide = A.describe_wide(t.part, PARTS, STATS)
    tidy = A.tidy_summary(wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns]), STATS)
    return tidy.withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query(
    "describe_bounds",
    """WITH v AS (SELECT 'value' AS variable, value FROM events UNION ALL SELECT 'value_log', ln(1 + value) FROM events),
    s AS (SELECT variable, avg(value) AS m, stddev_samp(value) AS sd FROM v GROUP BY 1)
    SELECT variable, round(m, 4) AS mean, round(sd, 4) AS sd, round(m - sd, 4) AS "from", round(m + sd, 4) AS "to",
      CASE WHEN variable LIKE '%log%' THEN round(exp(m - sd), 4) END AS exp_from,
      CASE WHEN variable LIKE '%log%' THEN round(exp(m + sd), 4) END AS exp_to FROM s""",
)
def describe_bounds(t):
    b = A.sd_bounds(t.events.select("value", F.log1p("value").alias("value_log")), ["value", "value_log"])
    return b.withColumns({c: F.round(c, 4) for c in b.columns if c != "variable"})


@query(
    "agg_filtered_sum",
    """SELECT o_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority > '3'), 0) AS DOUBLE) AS total
      FROM orders GROUP BY 1""",
)
def agg_filtered_sum(t):
    total = N.sum_where(N.money("o_totalprice"), F.col("o_orderpriority") > "3")
    return t.orders.groupBy("o_custkey").agg(total.cast("double").alias("total"))


@query(
    "agg_flag_share",
    """SELECT o_orderpriority, round(sum(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS percent
      FROM orders GROUP BY 1""",
)
def agg_flag_share(t):
    high = N.flag(F.col("o_totalprice") >= 250000)
    return t.orders.groupBy("o_orderpriority").agg(F.round(A.flag_share(high), 4).alias("percent"))


@query(
    "agg_null_share",
    """WITH j AS (SELECT nullif(lang, 'en') AS lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT 'lang' AS variable, round(avg(CASE WHEN lang IS NULL THEN 100 ELSE 0 END), 4) AS percent FROM j
    UNION ALL SELECT 'quality', round(avg(CASE WHEN quality IS NULL THEN 100 ELSE 0 END), 4) FROM j
    UNION ALL SELECT 'toxic', round(avg(CASE WHEN toxic IS NULL THEN 100 ELSE 0 END), 4) FROM j""",
)
def agg_null_share(t):
    docs = t.documents.select("doc_id", F.nullif("lang", F.lit("en")).alias("lang")).join(t.labels, "doc_id", "left")
    return A.null_share(docs, ["lang", "quality", "toxic"]).withColumn("percent", F.round("percent", 4))


@query(
    "agg_distinct_ends",
    """SELECT count(*) AS n_states FROM (SELECT c_nationkey AS k FROM orders JOIN customer ON c_custkey = o_custkey
      UNION SELECT s_nationkey FROM supplier)""",
)
def agg_distinct_ends(t):
    hosts = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).selectExpr("c_nationkey AS a", "NULL AS b")
    return A.distinct_ends(hosts.unionByName(t.supplier.selectExpr("NULL AS a", "s_nationkey AS b")), "a", "b")


@query(
    "agg_argmax",
    """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
)
def agg_argmax(t):
    counts = A.count_by(t.events, "user_id", "event_type")
    return O.first_per_group(counts, ["user_id"], [F.desc("n"), F.asc("event_type")])


@query(
    "agg_concat",
    """SELECT l_orderkey, string_agg(nation, ',' ORDER BY nation) AS members FROM (SELECT DISTINCT l_orderkey,
      lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1""",
)
def agg_concat(t):
    members = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        "l_orderkey", F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("nation")
    )
    return A.concat_members(members, ["l_orderkey"], "nation")


@query(
    "agg_total_row",
    """SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM orders""",
)
def agg_total_row(t):
    return A.add_total_row(A.count_by(t.orders.withColumnRenamed("o_orderpriority", "kind"), "kind"))


@query(
    "agg_grouping_sets",
    """WITH j AS (SELECT r_name AS region, o_orderpriority AS typology FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT region, typology, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'World', typology, count(*) FROM j GROUP BY 2""",
)
def agg_grouping_sets(t):
    return A.with_world(_order_regions(t), "region", "typology")


def _order_regions(t):
    return (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("typology"))
    )


@query(
    "agg_first_last",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders)
    SELECT f.o_custkey, f.o_orderkey AS first_order, l.o_orderkey AS last_order FROM r f JOIN r l USING (o_custkey)
      WHERE f.a = 1 AND l.z = 1""",
)
def agg_first_last(t):
    ends = O.first_and_last(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    return ends.withColumnsRenamed({"first": "first_order", "last": "last_order"})


@query("agg_rowcount", "WITH " + B.FLOWS_SQL + " SELECT count(*) AS n_pairs, count(DISTINCT state1) AS n_states FROM flows")
def agg_rowcount(t):
    return B.flows(t).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("state1").alias("n_states"))


@query(
    "share_of_total",
    """SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS percent
      FROM orders GROUP BY 1""",
)
def share_of_total(t):
    s = A.share_within(t.orders, [], ["o_orderpriority"])
    return s.select("o_orderpriority", "n", F.round("percent", 4).alias("percent"))
