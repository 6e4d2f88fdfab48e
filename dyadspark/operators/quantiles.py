"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadspark.functions.nulls import col
from dyadspark.operators.ordered import join_same
from dyadspark.session import stored

DIGITS = (48, 32, 16, 0)  # where the four digits of 16 bits begin


def order_code(v: Column) -> Column:
    """The bits of a double as a long of the same order (negative zero counts as zero)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _digit(shift: int) -> Column:
    """One digit of the code; the first one is signed, like the code."""
    part = F.shiftright("_c", shift)
    return part if shift == DIGITS[0] else part.bitwiseAND(F.lit(0xFFFF))


def exact_median(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "median", **also: Column) -> DataFrame:
    """Exact median per group, NULL values ignored; NULL for a group without values.

    Built-in exact percentiles keep every distinct value of a group in the memory of one task. Here the median is
    selected digit by digit on the order-preserving bit pattern of the values: four rounds whatever the values are. A
    round counts the rows per digit (map-side, at most 65,536 counts per group are shuffled and put in order) and goes
    on with the digit that holds the middle row. Behind the first round only that digit's distinct values are kept,
    with their counts. The value after the middle one, needed for groups of even size, is the least one of the next
    digit. Other aggregates over the column ``_v`` can be taken ``also`` in the first pass.
    """
    if not keys:
        return exact_median(df.withColumn("_whole", F.lit(0)), ["_whole"], value, name, **also).drop("_whole")
    data = df.select(*keys, col(value).cast("double").alias("_v"))
    first = stored(data.groupBy(*keys).agg(F.count("_v").alias("_all"), *[a.alias(n) for n, a in also.items()]))
    coded = data.where(F.col("_v").isNotNull()).withColumn("_c", order_code(F.col("_v")))
    low_rank, high_rank = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    by_digit = Window.partitionBy(*keys).orderBy("_d")

    def chosen(counts: DataFrame) -> DataFrame:
        """The digit of each group that holds the lower middle row; counts are (keys, _all, _below, _next, _d, _n, _v)."""
        upto = F.col("_below") + F.sum("_n").over(by_digit.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marked = counts.withColumns({"_until": upto, "_after": F.lead("_v").over(by_digit)})
        held = marked.where((F.col("_until") >= low_rank) & (F.col("_until") - F.col("_n") < low_rank))
        return held.withColumns({"_below": F.col("_until") - F.col("_n"), "_next": F.coalesce("_after", "_next")}).drop("_after")

    state = ["_all", "_below", "_next"]
    start = first.select(*keys, "_all", F.lit(0).cast("bigint").alias("_below"), F.lit(None).cast("double").alias("_next"))
    counts = coded.groupBy(*keys, _digit(DIGITS[0]).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"))
    now = stored(chosen(join_same(counts, start, keys, "inner")))
    inside = join_same(coded.withColumn("_d", _digit(DIGITS[0])), now.select(*keys, "_d"), [*keys, "_d"], "inner")
    rest = stored(inside.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v")))
    for before, shift in zip(DIGITS, DIGITS[1:]):
        held = now.select(*keys, *state, F.col("_p" if before != DIGITS[0] else "_d").alias("_p"))
        prefix = F.shiftright("_c", before)
        joined = join_same(rest.withColumn("_p", prefix), held, [*keys, "_p"], "inner")
        counts = joined.groupBy(*keys, *state, "_p", _digit(shift).alias("_d")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_v"))
        now = chosen(counts).withColumn("_p", F.shiftleft("_p", 16).bitwiseOR(F.col("_d")))
    middle = F.when(F.col("_until") >= high_rank, F.col("_v")).otherwise((F.col("_v") + F.col("_next")) / 2)
    return join_same(first.select(*keys, *also), now.select(*keys, middle.alias(name)), keys)


def describe_long(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """Mean, standard deviation, median, minimum, maximum and number of valid values per group."""
    v = F.col("_v")
    return exact_median(
        df, keys, value, mean=F.avg(v), sd=F.stddev_samp(v), min=F.min(v), max=F.max(v), obs=F.count(v)
    )
