"""Projections and scalar functions."""

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import columns as C
from dyadspark.plans.registry import query

LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("proj_select", "SELECT o_orderkey AS id, o_custkey AS state, o_totalprice FROM orders")
def proj_select(t):
    kept = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("state"), "o_totalprice", "o_orderstatus")
    return kept.drop("o_orderstatus")


@query("proj_pattern", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def proj_pattern(t):
    return C.select_matching(t.orders, r"pri(ce|ority)$", keep=["o_orderkey"])


@query("proj_position", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def proj_position(t):
    return C.select_positions(t.customer, [0, 1, 2, 4])


@query(
    "proj_derive",
    """SELECT o_orderkey, o_totalprice / 1000 AS price_k, o_totalprice / 1000 * 2 AS twice_k,
      CASE WHEN o_totalprice / 1000 * 2 > 500 THEN 1 ELSE 0 END AS large FROM orders""",
)
def proj_derive(t):
    return (
        t.orders.withColumn("k", F.col("o_totalprice") / 1000)
        .withColumn("twice", F.col("k") * 2)
        .withColumn("large", N.flag(F.col("twice") > 500))
        .select("o_orderkey", F.col("k").alias("price_k"), F.col("twice").alias("twice_k"), "large")
    )


@query(
    "across_suffix",
    """SELECT p_partkey, p_size, p_retailprice, round(ln(1 + p_size), 4) AS p_size_log,
      round(ln(1 + p_retailprice), 4) AS p_retailprice_log FROM part""",
)
def across_suffix(t):
    logged = C.across(t.part, ["p_size", "p_retailprice"], {"log": lambda c: F.round(F.log1p(c), 4)})
    return logged.select("p_partkey", "p_size", "p_retailprice", "p_size_log", "p_retailprice_log")


@query("rename_clean", 'SELECT s_suppkey AS supplier_key, s_name AS name_of_state, s_acctbal AS balance_percent FROM supplier')
def rename_clean(t):
    raw = t.supplier.select(
        F.col("s_suppkey").alias("SupplierKey"), F.col("s_name").alias("Name of State"), F.col("s_acctbal").alias("Balance (%)")
    )
    return C.clean_names(raw)


@query("proj_relocate", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def proj_relocate(t):
    return C.relocate(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), ["o_orderpriority"], before="o_orderkey")


@query("promote_header", "SELECT c_custkey + 1 AS ordinal, c_name AS customer_name, c_mktsegment AS market_segment FROM customer")
def promote_header(t):
    body = t.customer.select((F.col("c_custkey") + 1).alias("ordinal"), F.col("c_name").alias("V1"), F.col("c_mktsegment").alias("V2"))
    head = t.spark.createDataFrame([(0, "Customer Name", "Market Segment")], "ordinal BIGINT, V1 STRING, V2 STRING")
    return C.clean_names(C.promote_header(head.unionByName(body), "ordinal"))


@query(
    "remove_empty",
    """SELECT flag, status, count(*) AS n FROM (SELECT nullif(l_returnflag, 'N') AS flag, nullif(l_linestatus, 'O') AS status
      FROM lineitem) WHERE flag IS NOT NULL OR status IS NOT NULL GROUP BY ALL""",
)
def remove_empty(t):
    sparse = t.lineitem.select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.nullif("l_linestatus", F.lit("O")).alias("status"),
        F.when(F.col("l_quantity") < 0, 1).alias("nothing"),
    )
    return C.remove_empty(sparse).groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cast_safe",
    """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, TRY_CAST(o_orderstatus AS INT) AS nothing,
      TRY_CAST(o_orderpriority AS DOUBLE) AS no_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
      CAST(o_custkey AS VARCHAR) AS cust FROM orders""",
)
def cast_safe(t):
    return t.orders.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
        F.col("o_orderstatus").try_cast("int").alias("nothing"),
        F.col("o_orderpriority").try_cast("double").alias("no_number"),
        F.to_date("o_orderdate").cast("string").alias("day"),
        F.col("o_custkey").cast("string").alias("cust"),
    )


@query(
    "onehot_bind",
    """SELECT o_orderkey, o_orderpriority,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS priority_1_urgent,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS priority_2_high,
      CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS priority_3_medium,
      CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS priority_4_not_specified,
      CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS priority_5_low FROM orders""",
)
def onehot_bind(t):
    return C.one_hot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", LEVELS, "priority")


@query(
    "math_log",
    """SELECT event_id, round(ln(1 + value), 4) AS v_log1p, round(ln(value), 4) AS v_log, round(exp(value / 100), 4) AS v_exp,
      CASE WHEN value - 1 > 0 THEN round(ln(value - 1), 4) END AS v_log_shift FROM events""",
)
def math_log(t):
    v = F.col("value")
    return t.events.select(
        "event_id",
        F.round(F.log1p(v), 4).alias("v_log1p"),
        F.round(F.log(v), 4).alias("v_log"),
        F.round(F.exp(v / 100), 4).alias("v_exp"),
        F.round(F.log(v - 1), 4).alias("v_log_shift"),
    )


@query(
    "math_ratio",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit,
      l_quantity / nullif(l_discount, 0) AS per_discount, l_tax * 100 / nullif(l_discount, 0) AS tax_percent,
      l_extendedprice / 1000 / nullif(l_quantity, 0) AS unit_k FROM lineitem""",
)
def math_ratio(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        N.safe_div("l_extendedprice", "l_quantity").alias("unit"),
        N.safe_div("l_quantity", "l_discount").alias("per_discount"),
        N.percent("l_tax", "l_discount").alias("tax_percent"),
        N.safe_div(F.col("l_extendedprice") / 1000, "l_quantity").alias("unit_k"),
    )


@query(
    "math_absdiff",
    """SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 4) AS diff, round(abs(l_tax - l_discount), 4) AS absdiff
      FROM lineitem""",
)
def math_absdiff(t):
    diff = F.col("l_tax") - F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(diff, 4).alias("diff"), F.round(F.abs(diff), 4).alias("absdiff"))


@query(
    "math_bround",
    """SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS half,
      CAST(round_even(l_quantity / 4, 1) AS DOUBLE) AS tenth FROM lineitem""",
)
def math_bround(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", N.half_even(q / 2).alias("half"), N.half_even(q / 4, 1).alias("tenth"))


@query(
    "null_sentinel",
    """SELECT l_returnflag, count(*) AS n, count(nullif(l_discount, 0)) AS known, round(avg(nullif(l_discount, 0)), 4) AS mean
      FROM lineitem GROUP BY 1""",
)
def null_sentinel(t):
    d = N.na_if("l_discount", [0.0])
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count(d).alias("known"), F.round(F.avg(d), 4).alias("mean")
    )


@query(
    "null_fill",
    """SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d
      LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def null_fill(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(
    "case_when",
    """SELECT relation, kind, count(*) AS n FROM (SELECT
      CASE WHEN c = 0 AND s = 0 THEN 'none' WHEN c = 1 AND s = 0 THEN 'sender' WHEN c = 0 AND s = 1 THEN 'receiver' END AS relation,
      CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS kind
      FROM (SELECT l_quantity, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS c,
        CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS s FROM lineitem)) GROUP BY ALL""",
)
def case_when(t):
    from dyadspark.operators.dyads import relation_status

    sender = N.flag(F.nullif("l_returnflag", F.lit("N")) == "R")
    receiver = N.flag(F.col("l_linestatus") == "O")
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return (
        t.lineitem.select(relation_status(sender, receiver, ("none", "sender", "receiver")).alias("relation"), size.alias("kind"))
        .groupBy("relation", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "if_else_null",
    """SELECT is_high, count(*) AS n FROM (SELECT CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN NULL
      WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_high FROM orders) GROUP BY 1""",
)
def if_else_null(t):
    known = N.na_if("o_orderstatus", ["P"])
    return t.orders.select(N.flag(known == "F").alias("is_high")).groupBy("is_high").agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_min_max",
    """SELECT l_orderkey, l_linenumber, CASE WHEN f IS NOT NULL THEN least(f, l_linestatus) END AS lo,
      CASE WHEN f IS NOT NULL THEN greatest(f, l_linestatus) END AS hi
      FROM (SELECT l_orderkey, l_linenumber, l_linestatus, nullif(l_returnflag, 'N') AS f FROM lineitem)""",
)
def row_min_max(t):
    f = F.nullif("l_returnflag", F.lit("N"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", N.row_min(f, "l_linestatus").alias("lo"), N.row_max(f, "l_linestatus").alias("hi")
    )


@query(
    "coalesce_priority",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.05 THEN l_tax END, CASE WHEN l_discount > 0 THEN l_discount END,
      l_quantity) AS best FROM lineitem""",
)
def coalesce_priority(t):
    third, second = F.when(F.col("l_tax") > 0.05, F.col("l_tax")), F.when(F.col("l_discount") > 0, F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", N.right_most("l_quantity", second, third).alias("best"))


@query(
    "rescale_rows",
    """SELECT event_type, CASE WHEN event_type = 'error' THEN total / 1000 ELSE total END AS total FROM (SELECT event_type,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1)""",
)
def rescale_rows(t):
    total = t.events.groupBy("event_type").agg(F.sum(N.money("value")).cast("double").alias("total"))
    scaled = F.when(F.col("event_type") == "error", F.col("total") / 1000).otherwise(F.col("total"))
    return total.withColumn("total", scaled)


@query(
    "factor_levels",
    """SELECT label, ordinal, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High'
      WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS label,
      CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 4 END AS ordinal
      FROM orders) GROUP BY ALL""",
)
def factor_levels(t):
    order = ["3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW"]
    labels = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}
    return (
        t.orders.select(C.relabel("o_orderpriority", labels).alias("label"), C.level_index("o_orderpriority", order).alias("ordinal"))
        .groupBy("label", "ordinal")
        .agg(F.count(F.lit(1)).alias("n"))
    )
