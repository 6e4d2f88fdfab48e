"""The missing-value rules one by one."""

import math

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import joins as J
from dyadspark.operators.ordered import attach_group, first_per_group


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_strict_sum_and_sum_of_nothing(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0), ("c", None)], "k STRING, v DOUBLE")
    got = df.groupBy("k").agg(N.sum_strict("v").alias("s"), N.sum0("v").alias("z"))
    assert rows(got) == [("a", None, 1.0), ("b", 5.0, 5.0), ("c", None, 0.0)]


def test_null_keys_match_each_other(spark, rows):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k STRING, v INT")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k STRING, w INT")
    assert rows(J.natural_left(a, b)) == [(None, 1, 10), ("x", 2, None)]


def test_not_in_keeps_null_but_filter_drops_unknown(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k STRING")
    assert {r.k for r in df.where(N.not_in_list("k", ["a"])).collect()} == {None, "b"}
    assert {r.k for r in df.where(F.col("k") != "a").collect()} == {"b"}


def test_null_is_a_group(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k STRING, v INT")
    assert rows(attach_group(df, ["k"], s=F.sum("v"))) == [(None, 1, 3), (None, 2, 3), ("a", 3, 3)]


def test_half_even(spark):
    assert one(spark, N.half_even(F.lit(2.5))) == 2 and one(spark, N.half_even(F.lit(3.5))) == 4


def test_row_extremes_need_both(spark):
    null = F.lit(None).cast("int")
    assert one(spark, N.row_min(F.lit(1), null)) is None and one(spark, N.row_max(F.lit(1), F.lit(4))) == 4


def test_division_and_log_outside_domain(spark):
    assert one(spark, N.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, F.log1p(F.lit(-1.0))) is None
    assert math.isclose(one(spark, N.percent(F.lit(1.0), F.lit(8.0))), 12.5)


def test_numbers_that_are_none(spark):
    assert one(spark, F.lit("abc").try_cast("double")) is None and one(spark, F.lit("3.4").try_cast("int")) is None


def test_flag_and_sentinel(spark):
    assert one(spark, N.flag(F.lit(None).cast("boolean"))) is None and one(spark, N.flag(F.lit(False))) == 0
    assert one(spark, N.na_if(F.lit(-9), [-9])) is None and one(spark, N.na_if(F.lit(3), [-9])) == 3


def test_first_row_and_first_maximum_have_a_stated_order(spark, rows):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 3, "y"), ("a", 1, "x")], "k STRING, n INT, f STRING").repartition(3)
    assert rows(first_per_group(df, ["k"], [F.desc("n"), F.asc("f")])) == [("a", 3, "y")]


def test_right_most(spark):
    cols = [F.lit(None).cast("int"), F.lit(2001), F.lit(None).cast("int"), F.lit(2005)]
    assert one(spark, N.right_most(*cols)) == 2005 and one(spark, N.right_most(*cols[:3])) == 2001
