"""Grouped summaries and their layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.nulls import col, safe_div
from dyadspark.operators.ordered import attach_group
from dyadspark.operators.quantiles import describe_long

def n_rows() -> Column:
    return F.count(F.lit(1))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(n_rows().alias(name))


def null_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percent of missing values, one row per column, from one pass over the table."""
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "variable", "percent")


def distinct_ends(df: DataFrame, *cols: str, name: str = "n_states") -> DataFrame:
    """Number of distinct values found in any of the columns."""
    ends = df.select(F.explode(F.array(*cols)).alias("_end")).distinct()
    return ends.agg(F.count("_end").alias(name))


def share_within(df: DataFrame, outer: Sequence[str], inner: Sequence[str], digits: int | None = None) -> DataFrame:
    """Count per group and its percent of the outer group (of everything when ``outer`` is empty)."""
    counts = count_by(df, *outer, *inner)
    with_total = attach_group(counts, outer, total=F.sum("n"))
    share = safe_div(F.col("n") * 100, F.col("total"))
    return with_total.withColumn("percent", share if digits is None else F.bround(share, digits))


def with_world(df: DataFrame, region: str, kind: str, world: str = "World") -> DataFrame:
    """Counts of kinds per region together with the counts over all regions.

    Rows are counted first, so only the counts are rolled up, not the rows.
    """
    return (
        count_by(df, region, kind)
        .groupingSets([[F.col(region), F.col(kind)], [F.col(kind)]], region, kind)
        .agg(F.sum("n").alias("n"), F.grouping(region).alias("_all"))
        .withColumn(region, F.when(F.col("_all") == 1, world).otherwise(F.col(region)))
        .drop("_all")
    )


def add_total_row(df: DataFrame, label: str = "Total") -> DataFrame:
    """Append one row: numeric columns summed, text columns set to a label."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    total = df.agg(*[F.sum(c).alias(c) for c in df.columns if c not in text])
    return df.unionByName(total.withColumns({c: F.lit(label) for c in text}))


def describe_columns(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One tidy row of statistics per variable (and group)."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "variable", "value"
    )
    return describe_long(long, [*keys, "variable"], "value")


def describe_wide(df: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """The same statistics in one wide row, columns named ``variable_statistic``."""
    tidy = describe_columns(df, cols)
    cells = [F.max(F.when(F.col("variable") == c, F.col(s))).alias(f"{c}_{s}") for c in cols for s in stats]
    return tidy.agg(*cells)


def tidy_summary(wide: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Turn one wide ``variable_statistic`` row into one row per variable."""
    pattern = rf"^(.+)_({'|'.join(stats)})$"
    long = wide.unpivot([], wide.columns, "name", "value").select(
        F.regexp_extract("name", pattern, 1).alias("variable"), F.regexp_extract("name", pattern, 2).alias("stat"), "value"
    )
    return long.groupBy("variable").pivot("stat", list(stats)).agg(F.first("value"))


def sd_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sd and mean -/+ one sd per variable, back-transformed for logarithms."""
    long = df.unpivot([], list(cols), "variable", "value")
    stats = long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    bounds = stats.withColumns({"from": F.col("mean") - F.col("sd"), "to": F.col("mean") + F.col("sd")})
    is_log = F.col("variable").contains("log")
    return bounds.withColumns({f"exp_{c}": F.when(is_log, F.exp(c)) for c in ("from", "to")})


def concat_members(df: DataFrame, keys: Sequence[str], member: str, name: str = "members", sep: str = ",") -> DataFrame:
    """Distinct members per group as ordered text; members come from a code list, so the text is bounded."""
    return (
        df.select(*keys, member)
        .distinct()
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(member)), sep).alias(name))
    )


def flag_share(c: str | Column) -> Column:
    """Percent of rows with flag 1."""
    return F.sum(col(c)) / n_rows() * 100
