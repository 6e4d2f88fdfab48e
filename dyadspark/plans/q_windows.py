"""Group values on rows, ranks, running totals, fills and de-duplication."""

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import aggregates as A
from dyadspark.operators import ordered as O
from dyadspark.operators.dyads import dyad_key, flag_latest
from dyadspark.operators.quantiles import exact_median
from dyadspark.plans import base as B
from dyadspark.plans.registry import query
from dyadspark.session import stored


@query(
    "win_group_total",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total,
      CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) OVER (PARTITION BY o_custkey), 0)
      AS DOUBLE) AS total_f FROM orders""",
)
def win_group_total(t):
    price = N.money("o_totalprice")
    done = F.when(F.col("o_orderstatus") == "F", price)
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    totals = O.attach_group(rows, ["o_custkey"], total=N.sum0(price).cast("double"), total_f=N.sum0(done).cast("double"))
    return totals.select("o_orderkey", "total", "total_f")


@query(
    "win_share",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag), 4)
      AS percent FROM lineitem GROUP BY 1, 2""",
)
def win_share(t):
    s = A.share_within(t.lineitem, ["l_returnflag"], ["l_linestatus"])
    return s.select("l_returnflag", "l_linestatus", "n", F.round("percent", 4).alias("percent"))


@query(
    "win_share_total",
    """SELECT source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
      round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY 1""",
)
def win_share_total(t):
    s = A.share_within(t.documents, [], ["source"])
    return s.select("source", "n", "total", F.round("percent", 4).alias("percent"))


@query(
    "win_cumsum",
    """SELECT l_returnflag, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER w AS BIGINT) AS cum_n,
      CAST(sum(q) OVER w AS DOUBLE) AS cum_quantity FROM (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS n,
      sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)""",
)
def win_cumsum(t):
    daily = t.lineitem.groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(N.money("l_quantity")).alias("q")
    )
    cum = O.running(daily, ["l_returnflag"], ["day"], cum_n="n", cum_quantity="q")
    return cum.select("l_returnflag", F.col("day").cast("string"), "n", "cum_n", F.col("cum_quantity").cast("double"))


@query(
    "win_latest",
    """SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER
      (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE o_totalprice >= 150000""",
)
def win_latest(t):
    last = O.latest_if(
        t.orders, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_totalprice") >= 150000
    )
    return last.select("o_custkey", "o_orderstatus", "o_orderkey")


@query(
    "win_locf",
    """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(max(CASE WHEN event_type = 'purchase' THEN value END)
      AS DOUBLE) AS v FROM events GROUP BY ALL)
    SELECT user_id, day, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS v FROM d""",
)
def win_locf(t):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("v")
    )
    filled = O.fill_down(daily.withColumn("at", F.unix_date("day")), "at", ["v"], ["user_id"])
    return filled.select("user_id", F.col("day").cast("string").alias("day"), "v")


@query(
    "win_filldown",
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id
      ROWS UNBOUNDED PRECEDING) AS head FROM events""",
)
def win_filldown(t):
    sparse = t.events.select("event_id", F.when(F.col("event_type") == "signup", F.col("user_id")).alias("head"))
    return O.fill_down(sparse, "event_id", ["head"])


@query(
    "win_group_median",
    """SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS mean,
      median(p_retailprice) OVER (PARTITION BY p_type) AS median FROM part""",
)
def win_group_median(t):
    rows = O.attach_group(t.part.select("p_partkey", "p_type", "p_retailprice"), ["p_type"], few=True, mean=F.avg("p_retailprice"))
    rows = O.join_same(rows, exact_median(t.part, ["p_type"], "p_retailprice"), ["p_type"])
    return rows.select("p_partkey", F.round("mean", 4).alias("mean"), "median")


@query(
    "win_group_mean",
    """SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_returnflag, year(l_shipdate)), 4) AS mean
      FROM lineitem""",
)
def win_group_mean(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.year("l_shipdate").alias("year"))
    rows = O.attach_group(rows, ["l_returnflag", "year"], few=True, mean=F.avg("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", F.round("mean", 4).alias("mean"))


@query("win_group_n", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def win_group_n(t):
    rows = O.attach_group(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], n=F.count(F.lit(1)))
    return rows.select("event_id", "n")


@query(
    "win_dedup_first",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
      ORDER BY o_orderkey) = 1""",
)
def win_dedup_first(t):
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey")
    return O.first_per_group(rows, ["o_custkey", "o_orderpriority"], [F.asc("o_orderkey")])


@query(
    "win_dup_or_single",
    """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1
      OR count(*) OVER (PARTITION BY o_custkey) = 1""",
)
def win_dup_or_single(t):
    return O.later_or_single(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query(
    "win_extremes",
    """(SELECT o_orderkey, o_totalprice, 'max' AS "end" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
      UNION ALL (SELECT o_orderkey, o_totalprice, 'min' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)""",
)
def win_extremes(t):
    return O.extremes(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


@query(
    "win_dense_id",
    "WITH " + B.FLOWS_SQL + """, k AS (SELECT state1, state2, year, CAST(least(state1, state2) AS VARCHAR) || '_' ||
      CAST(greatest(state1, state2) AS VARCHAR) AS dyad FROM flows)
    SELECT state1, state2, year, dyad, dense_rank() OVER (ORDER BY dyad) AS dyad_id FROM k""",
)
def win_dense_id(t):
    keyed = B.flows(t).select("state1", "state2", "year", dyad_key("state1", "state2").alias("dyad"))
    return O.dense_ids(stored(keyed), "dyad", "dyad_id")


@query(
    "dyad_key",
    "WITH " + B.FLOWS_SQL + """, n AS (SELECT state1, state2, a.n_name AS x, b.n_name AS y, count(*) AS n FROM flows
      JOIN nation a ON a.n_nationkey = state1 JOIN nation b ON b.n_nationkey = state2 GROUP BY ALL)
    SELECT state1, state2, least(x, y) || '_' || greatest(x, y) AS dyad,
      dense_rank() OVER (ORDER BY least(x, y) || '_' || greatest(x, y)) AS dyad_id FROM n""",
)
def dyad_keys(t):
    from dyadspark.operators.dyads import add_both_ends

    names = t.nation.selectExpr("n_nationkey AS state", "n_name AS name")
    pairs = add_both_ends(B.flows(t).select("state1", "state2").distinct(), names, "state", {"name": "name"})
    return O.dense_ids(stored(pairs.select("state1", "state2", dyad_key("name1", "name2").alias("dyad"))), "dyad", "dyad_id")


@query(
    "win_blocks",
    """SELECT h.o_orderpriority AS label, o.o_orderkey AS ordinal, list_extract(['coef', 'se', 't', 'p', 'ci'],
      CAST(o.o_orderkey % 5 + 1 AS INT)) AS part FROM orders o JOIN orders h ON h.o_orderkey = (o.o_orderkey // 5) * 5""",
)
def win_blocks(t):
    lines = t.orders.select((F.col("o_orderkey") + 1).alias("line"), F.col("o_orderpriority").alias("label"))
    labelled = O.label_blocks(lines, "line", "label", ["coef", "se", "t", "p", "ci"])
    return labelled.select("label", (F.col("line") - 1).alias("ordinal"), "part")


@query("win_dup_report", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def win_dup_report(t):
    return A.count_by(t.customer, "c_nationkey", "c_mktsegment").where(F.col("n") > 1)


@query(
    "latest_flag",
    "WITH " + B.SHIPMENTS_SQL + """, last AS (SELECT state1, state2, year, typology FROM ship QUALIFY row_number() OVER
      (PARTITION BY state1, state2 ORDER BY o_orderkey DESC) = 1),
    kept AS (SELECT * FROM last WHERE year >= 1998), pairs AS (SELECT DISTINCT state1, state2 FROM ship)
    SELECT p.state1, p.state2, k.year AS last_year, typology AS outcome, CASE WHEN k.year IS NULL THEN 0 ELSE 1 END AS recent
      FROM pairs p LEFT JOIN kept k ON k.state1 = p.state1 AND k.state2 = p.state2""",
)
def latest_flag(t):
    # ties on the order are rows of one order and agree in every column used here
    last = stored(O.first_per_group(B.shipments(t), ["state1", "state2"], [F.desc("o_orderkey")]))
    recent = last.where(F.col("year") >= 1998)
    recent = recent.select("state1", "state2", F.col("year").alias("last_year"), F.col("typology").alias("outcome"))
    return flag_latest(last.select("state1", "state2"), recent, ["state1", "state2"], "recent")
