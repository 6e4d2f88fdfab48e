"""Shapes derived from the star schema: directed pair flows, country attributes, typed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.nulls import money
from dyadspark.operators.ordered import first_per_group
from dyadspark.plans.registry import Tables
from dyadspark.session import stored

SHIPMENTS_SQL = """
ship AS (SELECT s_nationkey AS state1, c_nationkey AS state2, CAST(year(o_orderdate) AS INT) AS year, o_orderkey,
    o_orderpriority AS typology, CAST(l_extendedprice AS DECIMAL(18,2)) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)"""

FLOWS_SQL = SHIPMENTS_SQL + """,
flows AS (SELECT state1, state2, year, sum(value) AS flow, count(*) AS n FROM ship GROUP BY ALL)"""

INFO_SQL = """
cust AS (SELECT c_nationkey AS k, count(*) AS pop, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS wealth
  FROM customer GROUP BY 1),
supp AS (SELECT s_nationkey AS k, count(*) AS polity, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS army
  FROM supplier GROUP BY 1),
info AS (SELECT n_nationkey AS state, n_name AS name, n_regionkey AS region, pop, wealth, polity, army
  FROM nation LEFT JOIN cust ON cust.k = n_nationkey LEFT JOIN supp ON supp.k = n_nationkey)"""

DYADS_SQL = INFO_SQL + "," + SHIPMENTS_SQL + """,
kinds AS (SELECT state1, state2, typology, count(*) AS n FROM ship WHERE state1 <> state2 GROUP BY ALL),
dyads AS (SELECT state1, state2, typology FROM kinds
  QUALIFY row_number() OVER (PARTITION BY state1, state2 ORDER BY n DESC, typology) = 1),
full_dyads AS (SELECT d.*, a.name AS name1, b.name AS name2, a.region AS region1, b.region AS region2,
    a.wealth AS wealth1, b.wealth AS wealth2, a.polity AS polity1, b.polity AS polity2
  FROM dyads d JOIN info a ON a.state = state1 JOIN info b ON b.state = state2)"""


def items(t: Tables) -> DataFrame:
    """One row per shipped item with the sending supplier; orders meet their customer first, so items move once."""
    ordered = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("c_nationkey").alias("state2"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("typology"),
    )
    return t.lineitem.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_suppkey", "state2", "year", "o_orderkey", "typology", money("l_extendedprice").alias("value")
    )


def senders(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("state1"))


def shipments(t: Tables) -> DataFrame:
    """One row per shipped item: sending country, receiving country, year, label and value."""
    return items(t).join(senders(t), "l_suppkey").select("state1", "state2", "year", "o_orderkey", "typology", "value")


def counted(t: Tables, *labels: str) -> DataFrame:
    """(state1, state2, year, labels, flow, n): summed per supplier first, so no item-sized table is shuffled for suppliers."""
    keys = ["state2", "year", *labels]
    per_supplier = items(t).groupBy("l_suppkey", *keys).agg(F.sum("value").alias("flow"), F.count(F.lit(1)).alias("n"))
    total = F.sum("flow").cast("decimal(28,2)").alias("flow")
    return per_supplier.join(senders(t), "l_suppkey").groupBy("state1", *keys).agg(total, F.sum("n").alias("n"))


def flows(t: Tables) -> DataFrame:
    """Directed pair-year flows; at most pairs x years rows whatever the size of the facts."""
    return counted(t)


def info(t: Tables) -> DataFrame:
    """One row per country with its own attributes."""
    cust = t.customer.groupBy(F.col("c_nationkey").alias("state")).agg(
        F.count(F.lit(1)).alias("pop"), F.sum(money("c_acctbal")).cast("double").alias("wealth")
    )
    supp = t.supplier.groupBy(F.col("s_nationkey").alias("state")).agg(
        F.count(F.lit(1)).alias("polity"), F.sum(money("s_acctbal")).cast("double").alias("army")
    )
    nation = t.nation.select(
        F.col("n_nationkey").alias("state"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")
    )
    return nation.join(cust, "state", "left").join(supp, "state", "left")


def kinds(t: Tables) -> DataFrame:
    """Shipments counted by pair, year and label, in one pass over the facts; at most pairs x years x labels rows."""
    return stored(counted(t, "typology").drop("flow"))


def dyads(t: Tables, counted: DataFrame | None = None) -> DataFrame:
    """Directed pairs of different countries with their most frequent label."""
    per_label = (
        (counted if counted is not None else shipments(t).withColumn("n", F.lit(1)))
        .where(F.col("state1") != F.col("state2"))
        .groupBy("state1", "state2", "typology")
        .agg(F.sum("n").alias("n"))
    )
    best = first_per_group(per_label, ["state1", "state2"], [F.desc("n"), F.asc("typology")])
    return best.select("state1", "state2", "typology")


def full_dyads(t: Tables) -> DataFrame:
    """Typed pairs with the attributes of both ends."""
    attrs = stored(info(t))  # one row per country, used for both ends

    def end(n: int) -> DataFrame:
        return attrs.select(
            F.col("state").alias(f"state{n}"),
            F.col("name").alias(f"name{n}"),
            F.col("region").alias(f"region{n}"),
            F.col("wealth").alias(f"wealth{n}"),
            F.col("polity").alias(f"polity{n}"),
        )

    return dyads(t).join(end(1), "state1").join(end(2), "state2")
