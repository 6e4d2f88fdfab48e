"""Ordered operators against plain Python, with one group that holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from dyadspark.operators import ordered as O
from dyadspark.operators import reshape as R
from dyadspark.operators.joins import complete_panel
from dyadspark.operators.quantiles import describe_long, exact_median


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        k = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        rows.append((i, k, rng.choice([None, None, rng.lognormvariate(3, 3)])))
    return rows


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("partitions", [None, 1, 13, 400])
def test_fill_down_over_partitions(spark, data, keys, partitions):
    df = spark.createDataFrame(data, "at BIGINT, k STRING, v DOUBLE").repartition(5)
    filled = O.fill_down(df, "at", ["v"], keys, partitions)
    assert filled.columns == df.columns
    got = {r.at: r.v for r in filled.collect()}
    last, want = {}, {}
    for at, k, v in data:
        g = k if keys else 0
        last[g] = v if v is not None else last.get(g)
        want[at] = last[g]
    assert got == want


def test_fill_down_of_several_columns(spark):
    """Text and number, small batches, a key that spans all partitions, and rows that nothing precedes."""
    rows = [(i, None if i % 3 else "only", f"t{i}" if i % 50 == 20 else None, i if i % 7 == 3 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "at INT, k STRING, t STRING, n INT")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.at: (r.k, r.t, r.n) for r in O.fill_down(df, "at", ["t", "n"], ["k"], 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for at, k, t, n in rows:
        old = last.get(k, (None, None))
        last[k] = (t or old[0], old[1] if n is None else n)
        assert got[at] == (k, *last[k])
    assert O.fill_down(df.limit(0), "at", ["t"]).count() == 0


def test_exact_median_of_skewed_groups(spark, data):
    df = spark.createDataFrame(data + [(9999, "empty", None)], "at BIGINT, k STRING, v DOUBLE")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    for k in ("hot", "a", "b", None):
        assert got[k] == pytest.approx(statistics.median(v for _, g, v in data if g == k and v is not None), rel=1e-12)
    assert got["empty"] is None


def test_median_with_gap_in_the_middle_and_repeats(spark):
    rows = [("g", v) for v in [0.0] * 50 + [1e9] * 50] + [("r", 5.0)] * 101
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], "v").collect()}
    assert got == {"g": 5e8, "r": 5.0}


def test_median_of_a_million_rows_of_one_group(spark):
    """Values from 1e-300 to 1e300 of both signs: the number of rounds does not depend on them."""
    power = (F.pmod(F.xxhash64("id"), F.lit(600_001)) / 1000) - 300
    value = F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0) * F.pow(F.lit(10.0), power)
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), value.alias("v"))
    got = exact_median(df, ["k"], "v").first().median
    assert got == statistics.median(r.v for r in df.select("v").collect())
    few = spark.createDataFrame([("a", v) for v in (-0.0, 0.0, 5e-324, -5e-324)] + [("b", float("-inf")), ("b", 1.0)], "k STRING, v DOUBLE")
    assert {r.k: r.median for r in exact_median(few, ["k"], "v").collect()} == {"a": 0.0, "b": float("-inf")}
    assert exact_median(few, [], "v").count() == 1 and exact_median(few.limit(0), ["k"], "v").count() == 0


def test_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("a", None)], "k STRING, v DOUBLE")
    (r,) = describe_long(df, ["k"], "v").collect()
    assert (r["mean"], r["median"], r["min"], r["max"], r["obs"]) == (3.0, 2.0, 1.0, 6.0, 3) and r.sd == pytest.approx(7**0.5)


def test_number_rows_and_running(spark, data):
    df = spark.createDataFrame(data, "at BIGINT, k STRING, v DOUBLE").withColumn("one", F.lit(2)).repartition(7)
    got = O.number_rows(df, [F.desc("at")], "no", running=("one", "sum")).collect()
    assert sorted((r.no, 2999 - r.at) for r in got) == [(i + 1, i) for i in range(3000)]
    assert all(r["sum"] == 2 * r.no for r in got)


def test_later_or_single(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5)], "k STRING, d INT")
    assert rows(O.later_or_single(df, ["k"], ["d"])) == [("a", 2), ("a", 3), ("b", 5)]


def test_latest_record_must_itself_qualify(spark, rows):
    df = spark.createDataFrame([("x", 1999, 1999), ("x", 2005, 2004), ("y", 1999, 1999), ("z", 2003, 1998), ("z", 2001, 2001)], "p STRING, year INT, start INT")
    assert rows(O.latest_if(df, ["p"], [F.desc("year")], F.col("start") >= 2000)) == [("x", 2005, 2004)]


def test_extremes_footer_blocks(spark, rows):
    df = spark.createDataFrame([(1, "gdp", 5.0), (2, "", 1.0), (3, "pop", 9.0), (4, "", None)], "line INT, label STRING, v DOUBLE")
    assert rows(O.extremes(df, "v", ["line"]).select("end", "line")) == [("max", 3), ("min", 2)]
    assert O.drop_last(df, "line").count() == 3
    assert rows(O.label_blocks(df, "line", "label", ["coef", "se"]).select("line", "label", "part")) == [(1, "gdp", "coef"), (2, "gdp", "se"), (3, "pop", "coef"), (4, "pop", "se")]


def test_running_ends_at_total(spark):
    df = spark.createDataFrame([("a", y, y) for y in range(1, 11)], "k STRING, y INT, n INT")
    assert O.running(df, ["k"], ["y"], c="n").agg(F.max("c")).first()[0] == 55


def test_complete_panel(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 7), (None, 1, 9)], "k STRING, y INT, n INT")
    assert rows(complete_panel(df, ["k"], "y", {"n": 0})) == [(None, 1, 9), (None, 2, 0), ("a", 1, 5), ("a", 2, 0), ("b", 1, 0), ("b", 2, 7)]


def test_nest_and_unnest(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, None)], "k STRING, y INT, n INT")
    assert rows(R.unnest(R.nest(df, ["k"], ["y", "n"]), ["k"])) == rows(df)
