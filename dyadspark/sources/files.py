"""Readers for delimited files and document folders, all with stated schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.nulls import na_if
from dyadspark.functions.text import additive_length
from dyadspark.operators.ordered import number_rows

WALLS_SCHEMA = (
    "state1 STRING, state2 STRING, begin INT, length STRING, characteristics STRING, source STRING,"
    " empty1 STRING, empty2 STRING, empty3 STRING"
)


def read_table(
    spark: SparkSession, path: str, schema: str, sep: str = ",", skip_lines: int = 0, ordinal: str | None = None
) -> DataFrame:
    """Delimited file, or a folder of such files, each with a header line behind ``skip_lines`` preamble lines.

    Lines are numbered within their split, and each file is cut by the numbers of its own first split, so rows are
    parsed in parallel. ``ordinal`` names a column for the row's number in its source (1 for the first row behind the
    header; files in order of their names), kept in a written table. Quoted line breaks need the plain reader.
    """
    if not skip_lines and ordinal is None:
        return spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"')
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    first = lines.where(F.col("_block") == 0).groupBy("_file").agg(F.min("_at").alias("_first"))
    behind = (F.col("_block") > 0) | (F.col("_at") - F.col("_first") > skip_lines)
    kept = lines.join(first, "_file").where(behind)
    row = F.from_csv("value", F.lit(schema), {"sep": sep, "quote": '"', "escape": '"'})
    if ordinal is None:
        return kept.select(row.alias("r")).select("r.*")
    numbered = number_rows(kept.select("value", "_file", "_block", F.col("_at").alias("_line")), ["_file", "_block", "_line"], ordinal)
    return numbered.select(ordinal, row.alias("r")).select(ordinal, "r.*")


def read_semicolon_walls(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon table of walls: decimal commas and summed lengths, ``/`` for no partner, empty trailing columns."""
    raw = spark.read.schema(WALLS_SCHEMA).csv(path, header=True, sep=";", quote='"', escape='"')
    return raw.drop("empty1", "empty2", "empty3").withColumns(
        {"length": additive_length("length"), "state2": na_if("state2", ["/"])}
    )


def read_profiles(
    spark: SparkSession,
    folder: str,
    regions: Sequence[str] | None = None,
    pattern: str = r"/([^/]+)/([a-z]{2})\.json$",
) -> DataFrame:
    """Corpus of one JSON document per file as (region, code, doc VARIANT).

    Region and code are taken from the path by the two groups of ``pattern``; regions are chosen by name.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select("value", F.url_decode(F.col("_metadata.file_path")).alias("path"))
    )
    docs = files.select(
        F.regexp_extract("path", pattern, 1).alias("region"),
        F.regexp_extract("path", pattern, 2).alias("code"),
        F.try_parse_json("value").alias("doc"),
    ).where(F.col("code") != "")
    return docs if regions is None else docs.where(F.col("region").isin(list(regions)))
