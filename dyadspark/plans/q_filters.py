"""Filters, sorts, limits and set operations."""

from functools import reduce

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import columns as C
from dyadspark.operators import ordered as O
from dyadspark.operators.dyads import exclude_pairs
from dyadspark.operators.profiles import where_path
from dyadspark.plans import base as B
from dyadspark.plans.q_columns import LEVELS
from dyadspark.plans.registry import query
from dyadspark.session import scratch_path
from dyadspark.sources.files import read_table


@query(
    "filter_basic",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice >= 300000 AND o_orderstatus <> 'P')
      OR o_orderpriority = '5-LOW'""",
)
def filter_basic(t):
    keep = ((F.col("o_totalprice") >= 300000) & (F.col("o_orderstatus") != "P")) | (F.col("o_orderpriority") == "5-LOW")
    return t.orders.where(keep).select("o_orderkey", "o_totalprice")


@query("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(t):
    return t.customer.where(N.in_list("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey", "c_mktsegment")


@query(
    "filter_not_in",
    """SELECT f, count(*) AS n FROM (SELECT nullif(l_returnflag, 'N') AS f FROM lineitem)
      WHERE f IS NULL OR f NOT IN ('A') GROUP BY 1""",
)
def filter_not_in(t):
    flags = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("f"))
    return flags.where(N.not_in_list("f", ["A"])).groupBy("f").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_between",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders
      WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_totalprice BETWEEN 100000 AND 200000""",
)
def filter_between(t):
    # the year range is stated as a range of dates so that it reaches the scan
    days = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (
        F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    )
    return t.orders.where(days & F.col("o_totalprice").between(100000, 200000)).select(
        "o_orderkey", F.year("o_orderdate").alias("year")
    )


@query(
    "filter_notnull",
    """SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
      WHERE quality IS NOT NULL AND nullif(lang, 'en') IS NOT NULL""",
)
def filter_notnull(t):
    docs = t.documents.select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    return docs.join(t.labels, "doc_id", "left").dropna(subset=["quality", "lang"]).select("doc_id", "quality")


@query(
    "filter_complete",
    """SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
      WHERE source IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""",
)
def filter_complete(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").dropna("any")


@query(
    "filter_regex",
    """SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(widget|bolt)$')
      OR starts_with(lower(p_name), 'hot')""",
)
def filter_regex(t):
    name = F.lower("p_name")
    return t.part.where(name.rlike("(widget|bolt)$") | name.startswith("hot")).select("p_partkey", "p_name")


@query(
    "filter_pair_excl",
    "WITH " + B.FLOWS_SQL + """
    SELECT state1, state2, CAST(sum(n) AS BIGINT) AS n FROM flows
      WHERE (state1, state2) NOT IN ((1, 2), (2, 1), (3, 7)) GROUP BY ALL""",
)
def filter_pair_excl(t):
    wrong = t.spark.createDataFrame([(1, 2), (2, 1), (3, 7)], "state1 INT, state2 INT")
    return exclude_pairs(B.flows(t), wrong).groupBy("state1", "state2").agg(F.sum("n").alias("n"))


@query(
    "filter_ordinal",
    """SELECT ordinal, c_name FROM (SELECT row_number() OVER (ORDER BY c_name DESC) AS ordinal, c_name FROM customer)
      WHERE ordinal NOT IN (1, 3, 16, 81)""",
)
def filter_ordinal(t):
    path = scratch_path(t.spark, "customer-lines")
    t.customer.select("c_name", "c_mktsegment").orderBy(F.desc("c_name")).write.csv(path, header=True)
    lines = read_table(t.spark, path, "c_name STRING, c_mktsegment STRING", ordinal="ordinal")
    return lines.where(N.not_in_list("ordinal", [1, 3, 16, 81])).select("ordinal", "c_name")


@query("filter_noself", "WITH " + B.FLOWS_SQL + " SELECT state1, state2, year, n FROM flows WHERE state1 <> state2")
def filter_noself(t):
    return B.flows(t).where(F.col("state1") != F.col("state2")).select("state1", "state2", "year", "n")


@query(
    "filter_group",
    """SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)
      USING (o_custkey)""",
)
def filter_group(t):
    sized = O.attach_group(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], n=F.count(F.lit(1)))
    return sized.where(F.col("n") >= 12).drop("n")


@query(
    "doc_path_regex",
    """SELECT event_id, event_type FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^[13]?7$')""",
)
def doc_path_regex(t):
    docs = t.events.select("event_id", "event_type", F.parse_json("props").alias("doc"))
    return where_path(docs, "doc", ["k"], "^[13]?7$").drop("doc")


@query("sort_multi", "SELECT n_name, n_regionkey, c_custkey, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sort_multi(t):
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select("n_name", "n_regionkey", "c_custkey", "c_acctbal").orderBy(
        "n_regionkey", F.desc("n_name"), F.asc_nulls_last("c_acctbal"), "c_custkey"
    )


@query("sort_custom", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def sort_custom(t):
    order = [LEVELS[i] for i in (2, 0, 1, 4, 3)]
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        C.level_index("o_orderpriority", order), F.desc("o_totalprice"), "o_orderkey"
    )


@query(
    "topk",
    """SELECT o_orderkey, round(o_totalprice / c_acctbal, 4) AS ratio FROM orders JOIN customer ON c_custkey = o_custkey
      WHERE c_acctbal > 0 ORDER BY o_totalprice / c_acctbal DESC, o_orderkey LIMIT 25""",
)
def topk(t):
    joined = t.orders.join(t.customer.where(F.col("c_acctbal") > 0), F.col("c_custkey") == F.col("o_custkey"))
    ratio = joined.select("o_orderkey", (F.col("o_totalprice") / F.col("c_acctbal")).alias("ratio"))
    return ratio.orderBy(F.desc("ratio"), "o_orderkey").limit(25).withColumn("ratio", F.round("ratio", 4))


@query("drop_footer", "SELECT o_orderkey AS ordinal, o_totalprice FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders)")
def drop_footer(t):
    return O.drop_last(t.orders.select(F.col("o_orderkey").alias("ordinal"), "o_totalprice"), "ordinal")


@query(
    "ratio_extremes",
    """SELECT o_orderpriority, round_even(max(o_totalprice) / min(o_totalprice), 0) AS ratio FROM orders GROUP BY 1""",
)
def ratio_extremes(t):
    ratio = N.safe_div(F.max("o_totalprice"), F.min("o_totalprice"))
    return t.orders.groupBy("o_orderpriority").agg(N.half_even(ratio).alias("ratio"))


@query(
    "set_union",
    """SELECT c_nationkey AS state, c_acctbal AS balance, c_mktsegment AS segment FROM customer
      UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""",
)
def set_union(t):
    a = t.customer.selectExpr("c_nationkey AS state", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_nationkey AS state", "s_acctbal AS balance")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "set_union_many",
    """SELECT 'customer' AS source, c_nationkey AS state, count(*) AS n FROM customer GROUP BY 2
      UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2
      UNION ALL SELECT 'nation', n_nationkey, count(*) FROM nation GROUP BY 2""",
)
def set_union_many(t):
    registry = {
        "customer": t.customer.selectExpr("c_nationkey AS state"),
        "supplier": t.supplier.selectExpr("s_nationkey AS state"),
        "nation": t.nation.selectExpr("n_nationkey AS state"),
    }
    tagged = [df.select(F.lit(name).alias("source"), "state") for name, df in registry.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))


@query("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def set_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_discount").distinct()


@query("set_intersect", "SELECT c_nationkey AS state FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.selectExpr("c_nationkey AS state").intersect(t.supplier.selectExpr("s_nationkey AS state"))


@query("set_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_except(t):
    rich = t.orders.where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("id"))
    return t.customer.select(F.col("c_custkey").alias("id")).join(rich, "id", "left_anti")


@query(
    "set_endpoints",
    "WITH " + B.FLOWS_SQL + " SELECT state1 AS state FROM flows UNION SELECT state2 FROM flows",
)
def set_endpoints(t):
    f = B.flows(t).select(F.explode(F.array("state1", "state2")).alias("state"))
    return f.distinct()


@query(
    "set_append_rows",
    """SELECT n_nationkey AS state, n_name AS name FROM nation UNION ALL VALUES (900, 'ADDED_A'), (901, 'ADDED_B')""",
)
def set_append_rows(t):
    added = t.spark.createDataFrame([(900, "ADDED_A"), (901, "ADDED_B")], "state INT, name STRING")
    return t.nation.selectExpr("n_nationkey AS state", "n_name AS name").unionByName(added)
