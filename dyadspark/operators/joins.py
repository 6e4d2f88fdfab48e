"""Joins with the missing-value rules and fan-out guards of panel work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.operators.ordered import join_same
from dyadspark.session import stored


def natural_left(df: DataFrame, other: DataFrame) -> DataFrame:
    """Left join on all shared column names; NULL keys match each other."""
    return join_same(df, other, [c for c in df.columns if c in other.columns])


def left_on(df: DataFrame, other: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Left join on differently named keys; the right keys are dropped."""
    cond = reduce(lambda a, b: a & b, [df[a] == other[b] for a, b in pairs.items()])
    return df.join(other, cond, "left").drop(*[other[b] for b in pairs.values()])


def full_on(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with the keys of both sides merged."""
    return df.join(other, list(keys), "full")


def join_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join a list of one-row-per-key tables on one key."""
    return reduce(lambda a, b: join_same(a, b, keys), frames)


def left_fill(df: DataFrame, other: DataFrame, keys: Sequence[str], fills: Mapping[str, object]) -> DataFrame:
    """Left join, then missing values of the joined columns set to a default."""
    return df.join(other, list(keys), "left").fillna(dict(fills))


def levels_of(df: DataFrame, c: str) -> Column:
    """Sorted distinct values of a category or calendar column, as a scalar array subquery."""
    return df.agg(F.array_sort(F.collect_set(c)).alias("levels")).scalar()


def expand_grid(df: DataFrame, **levels: Column) -> DataFrame:
    """Every row combined with every element of small level arrays (no join)."""
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(values))
    return df


def complete_panel(df: DataFrame, keys: Sequence[str], period: str, fills: Mapping[str, object]) -> DataFrame:
    """Every observed key combined with every observed period; absent rows get the fill values.

    The input is stored first, since keys, periods and rows are taken from it.
    """
    df = stored(df)
    grid = df.select(*keys).distinct().withColumn(period, F.explode(levels_of(df, period)))
    return join_same(grid, df, [*keys, period]).fillna(dict(fills))
