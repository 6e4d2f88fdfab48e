"""Column selection, renaming and column-wise application."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name matches a regular expression, after the ones named in ``keep``."""
    return df.select(*keep, *[c for c in df.columns if re.search(pattern, c) and c not in keep])


def select_positions(df: DataFrame, positions: Iterable[int]) -> DataFrame:
    """Columns by zero-based position (names are safer wherever they are known)."""
    return df.select(*[df.columns[i] for i in positions])


def across(
    df: DataFrame, cols: Iterable[str], fns: dict[str, Callable[[str], Column]], name: str = "{col}_{fn}"
) -> DataFrame:
    """Apply functions to many columns, naming results by a template; existing columns stay."""
    return df.withColumns({name.format(col=c, fn=n): f(c) for c in cols for n, f in fns.items()})


def aggregates(cols: Iterable[str], fns: dict[str, Callable[[str], Column]], name: str = "{col}_{fn}") -> list[Column]:
    """The cross product of columns and aggregate functions as one list for ``agg``."""
    return [f(c).alias(name.format(col=c, fn=n)) for c in cols for n, f in fns.items()]


def clean_name(name: str) -> str:
    """snake_case form of a free-text column name."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", " percent ").replace("'", ""))
    return re.sub(r"[^0-9a-z]+", "_", spaced.lower()).strip("_")


def rename_with(df: DataFrame, fn: Callable[[str], str], pattern: str = "") -> DataFrame:
    """Rename by function the columns that match a pattern."""
    return df.withColumnsRenamed({c: fn(c) for c in df.columns if re.search(pattern, c)})


def clean_names(df: DataFrame) -> DataFrame:
    return rename_with(df, clean_name)


def relocate(df: DataFrame, cols: Sequence[str], before: str | None = None) -> DataFrame:
    """Move columns to the front or before another column."""
    rest = [c for c in df.columns if c not in cols]
    at = rest.index(before) if before else 0
    return df.select(*rest[:at], *cols, *rest[at:])


def promote_header(df: DataFrame, ordinal: str, row: int = 0) -> DataFrame:
    """Take the column names from the row with the given ordinal and drop that row."""
    head = df.where(F.col(ordinal) == row).first()
    names = {c: head[c] for c in df.columns if c != ordinal and head[c] is not None}
    return df.where(F.col(ordinal) != row).withColumnsRenamed(names)


def remove_empty(df: DataFrame, rows: bool = True, cols: bool = True) -> DataFrame:
    """Drop columns without any value (found in one pass) and rows in which every column is NULL."""
    if cols:
        filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
        df = df.select(*[c for c in df.columns if filled[c] > 0])
    return df.dropna("all") if rows else df


def one_hot(df: DataFrame, c: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """A 0/1 column per level beside the existing columns; NULL stays NULL."""
    stem = prefix or c
    value = F.col(c)
    return df.withColumns(
        {clean_name(f"{stem}_{v}"): F.when(value == v, 1).when(value.isNotNull(), 0) for v in levels}
    )


def level_index(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of a category in its level list, NULL if not listed."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value.isin(list(levels)), F.array_position(F.array(*[F.lit(v) for v in levels]), value).cast("int"))


def relabel(c: str | Column, labels: dict[str, str]) -> Column:
    """Replace category codes by labels; codes without a label become NULL."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(value == k, v) for k, v in labels.items()])
