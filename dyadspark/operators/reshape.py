"""Long, wide, nested and unnested forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.nulls import col


def longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long, NULL values kept."""
    return df.unpivot(list(ids), list(cols), name, value)


def wider(df: DataFrame, ids: Sequence[str], name: str, value: str | Column, levels: Sequence, fill=None) -> DataFrame:
    """Long to wide for a stated list of levels (one pass), with a fill value for absent cells."""
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(F.first(col(value), ignorenulls=True))
    return wide if fill is None else wide.fillna(fill, [str(v) for v in levels])


def split_columns(df: DataFrame, c: str, sep: str, into: Sequence[str]) -> DataFrame:
    """Split text into a fixed number of columns; missing pieces are NULL."""
    pieces = F.split(F.col(c), sep)
    return df.withColumns({n: F.get(pieces, F.lit(i)) for i, n in enumerate(into)}).drop(c)


def split_rows(df: DataFrame, c: str, sep: str) -> DataFrame:
    """One row per piece of a separated text."""
    return df.withColumn(c, F.explode(F.split(F.col(c), sep)))


def unnest_together(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays to rows; an empty or missing array keeps its row with NULLs."""
    rest = [c for c in df.columns if c not in arrays]
    zipped = df.select(*rest, F.explode_outer(F.arrays_zip(*arrays)).alias("_z"))
    return zipped.select(*rest, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def nest(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "data") -> DataFrame:
    """One ordered array of rows per group. For summaries that hold one row per period or category only."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def unnest(df: DataFrame, keys: Sequence[str], name: str = "data") -> DataFrame:
    return df.select(*keys, F.inline(name))


def pivot_by_source(
    df: DataFrame, keys: Sequence[str], source: str, value: str, levels: Sequence[str], pick=F.min
) -> DataFrame:
    """One column per source with its (earliest) value, one row per key."""
    return df.groupBy(*keys).pivot(source, list(levels)).agg(pick(value))
