"""Printable tables: distributions with totals and regression layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.functions import text as X
from dyadspark.functions.nulls import percent
from dyadspark.operators.aggregates import add_total_row, with_world
from dyadspark.operators.ordered import attach_group, label_blocks
from dyadspark.operators.reshape import longer, split_columns, wider
from dyadspark.session import stored


def distribution(df: DataFrame, region: str, kind: str, regions: Sequence[str], world: str = "World", digits: int = 1) -> DataFrame:
    """Percent of each kind per region and over all, regions in columns."""
    counts = attach_group(stored(with_world(df, region, kind, world)), [region], total=F.sum("n"))
    shares = counts.withColumn("percent", F.bround(percent("n", "total"), digits))
    return wider(shares, [kind], region, "percent", [*regions, world], fill=0.0)


def selected_total(table: DataFrame, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Some rows of a distribution with their total."""
    return add_total_row(table.where(F.col(kind).isin(list(kinds))))


def tidy_estimates(
    lines: DataFrame, order: str, label: str, classes: Sequence[str], rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Five-line blocks (coef, se, t, p, "low,high") per term to one row per term and class.

    Cells ``0``, ``.`` and ``.,.`` stand for missing, and a line with a missing cell is dropped.
    """
    named = label_blocks(lines, order, label, ["coef", "se", "t", "p", "ci"], "type")
    cleaned = named.withColumns({c: X.listed_to_null(f"`{c}`", ["0", ".", ".,."]) for c in classes}).dropna(subset=list(classes))
    long = longer(cleaned, [label, "type"], classes, "class", "value")
    wide = wider(long, [label, "class"], "type", "value", ["coef", "se", "t", "p", "ci"])
    pieces = split_columns(wide, "ci", ",", ["low", "high"])
    numbers = pieces.withColumns({c: F.col(c).try_cast("double") for c in ("coef", "se", "t", "p", "low", "high")})
    term = F.coalesce(*[F.when(F.col(label) == k, v) for k, v in (rename or {}).items()], F.col(label))
    return numbers.withColumn(label, F.regexp_replace(term, r"1\.", "")).withColumn("stars", X.stars("p"))


def regression_table(estimates: DataFrame, term: str, classes: Sequence[str]) -> DataFrame:
    """Two rows per term, ``coef`` with stars and ``(se)``, classes in columns."""
    coef, se = X.estimate_cells("coef", "se", "p")
    cells = estimates.select(term, "class", coef.alias("coef"), se.alias("se"))
    long = longer(cells, [term, "class"], ["coef", "se"], "line", "cell")
    return wider(long, [term, "line"], "class", "cell", classes)
