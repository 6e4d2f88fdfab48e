"""Country-profile documents: nested paths, neighbour tables, rankings and almanac rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions import text as X
from dyadspark.functions.nulls import col, sum_strict
from dyadspark.operators.codes import recode_name

NEIGHBOUR_PATH = ("Geography", "Land boundaries", "border countries")
TERRAIN = ("Geography", "Terrain")


def value_at(doc: str | Column, *path: str) -> Column:
    """Text of the value below a path of keys (blanks allowed in keys); NULL if any step is missing."""
    return F.variant_get(col(doc), "$" + "".join(f"['{p}']" for p in path), "string")


def path_text(doc: str | Column, *path: str) -> Column:
    """The ``text`` leaf below a path of keys."""
    return value_at(doc, *path, "text")


def where_path(df: DataFrame, doc: str, path: Sequence[str], pattern: str) -> DataFrame:
    """Documents whose value at a full path matches a pattern."""
    return df.where(value_at(doc, *path).rlike(pattern))


def neighbour_rows(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per neighbour named in a border text; a row without a text stays with NULLs."""
    return df.select(*keys, F.explode_outer(X.neighbour_lengths(text)).alias("_e")).select(
        *keys, F.col("_e.neighbour").alias("neighbour"), F.col("_e.km").alias("km")
    )


def rank_quantity(df: DataFrame, doc: str, path: Sequence[str], keys: Sequence[str], k: int | None = None) -> DataFrame:
    """Documents ordered by the quantity stated at a path."""
    ranked = df.select(*keys, X.quantity(path_text(doc, *path)).alias("quantity")).where(F.col("quantity").isNotNull())
    ordered = ranked.orderBy(F.desc("quantity"), *keys)
    return ordered.limit(k) if k else ordered


def almanac(df: DataFrame, doc: str, keys: Sequence[str], fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """A flat row per document from named paths."""
    return df.select(*keys, *[path_text(doc, *path).alias(name) for name, path in fields.items()])


def neighbour_lengths(
    profiles: DataFrame,
    crosswalk: DataFrame,
    dictionary: Sequence[tuple[str, str]],
    overrides: Mapping | None = None,
    unnamed: Mapping | None = None,
) -> DataFrame:
    """Border length per directed pair with the terrain of the first country.

    ``crosswalk`` is (code, id). Neighbour names go through the dictionary; several pieces of one border are summed,
    and a country without land neighbours keeps one row with NULLs. ``unnamed`` gives countries whose profile names no
    neighbour the one they have.
    """
    known = profiles.join(crosswalk, "code").select(
        F.col("id").alias("state1"),
        path_text("doc", *NEIGHBOUR_PATH).alias("neighbours"),
        path_text("doc", *TERRAIN).alias("terrain"),
    )
    rows = neighbour_rows(known, "neighbours", ["state1", "terrain"])
    coded = recode_name(rows, "neighbour", dictionary, "state2", overrides)
    for state, neighbour in (unnamed or {}).items():
        missing = F.col("state2").isNull() & (F.col("state1") == state)
        coded = coded.withColumn("state2", F.when(missing, F.lit(neighbour)).otherwise(F.col("state2")))
    return coded.groupBy("state1", "state2", "terrain").agg(sum_strict("km").alias("km"))
