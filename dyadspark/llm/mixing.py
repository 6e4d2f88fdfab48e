"""Mixing sources to target weights by systematic sampling.

Targets: the sources share a budget (``share`` of all sizes) by their weights; no source gets more than ``most`` times
its own size, and what is cut off goes to the others by weight, until no source is above its limit.

Copies: within a source every document is expected equally often (target / size of the source). The expected copies are
summed up in one order, a random offset is added, and a document is taken once per whole number that its stretch of the
sum crosses; so it is taken either the rounded-down or the rounded-up number of times. The order goes by falling size:
neighbours are alike, and the words taken of a source miss its target by less than its longest document.

The sum is the document's number in its source times a constant. Numbers come from one range partitioning by (source,
size, key), in which only one row per partition is carried across; a source with a third of all rows is spread like any
other. The offset is a digest of seed and source, so reruns and other partitionings agree.

A null source is a source of its own and comes last; documents of size 0 (and null sizes) take part and add no words;
sources of size 0 get nothing; null keys and repeated rows are rows like others; rows that are the same in all columns
of the order may exchange their copies. Other columns are kept, and new ones whose name is taken get leading underscores.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import free_name
from dyadspark.operators.ordered import join_same, number_rows
from dyadspark.session import stored

SEED = 42


def weighed(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (one row each, with ``number_`` from 1 and ``size_``) and ``target_``.

    Weights repeat along the numbers. Every round sets the level at which the open sources use up what is left, and
    closes those whose limit lies below it; the level only rises, and one row per round reaches the driver.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number_") - 1, F.lit(len(weights))).cast("int"))
    sources = stored(sources.withColumns({"weight_": weight, "limit_": most * F.col("size_")}))
    budget = share * (sources.agg(F.sum("size_")).first()[0] or 0)
    level = 0.0
    while True:
        closed = level * F.col("weight_") > F.col("limit_")
        spent, left = sources.agg(F.sum(F.when(closed, F.col("limit_"))), F.sum(F.when(~closed, F.col("weight_")))).first()
        higher = (budget - (spent or 0.0)) / left if left else level
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target_", F.least(level * F.col("weight_"), F.col("limit_"))).drop("weight_", "limit_")


def offset(source: str, seed: int) -> Column:
    """A number from 0 to 1 (excluded) per source."""
    digest = F.sha2(F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit(":"), F.col(source).cast("string")), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled(
    df: DataFrame, source: str = "source", size: str = "size", order: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED,
) -> DataFrame:
    """All columns of ``df`` and ``source_size`` long, ``target`` double (its source's), ``copies`` long (0 or more).

    ``order`` breaks ties of size. ``df`` is read twice; where it is costly, pass a stored table.
    """
    names = [free_name(df, c) for c in ("source_size", "target", "copies")]
    tie, words = F.monotonically_increasing_id(), F.coalesce(F.col(size), F.lit(0))
    rows = df.withColumns({"tie_": tie, "words_": words})
    rows = number_rows(rows, [F.col(source).asc_nulls_first(), F.col("words_").desc(), *order, "tie_"], "place_")
    sources = rows.groupBy(source).agg(F.sum("words_").cast("long").alias("size_"), F.min("place_").alias("first_"))
    ranked = number_rows(sources, [F.col(source).asc_nulls_last()], "number_")
    targets = stored(weighed(ranked, weights, share, most).withColumn("offset_", offset(source, seed)).drop("number_"))
    expected = F.when(F.col("size_") > 0, F.col("target_") / F.col("size_")).otherwise(0.0)
    before = (F.col("place_") - F.col("first_")) * expected + F.col("offset_")
    after = (F.col("place_") - F.col("first_") + 1) * expected + F.col("offset_")
    out = join_same(rows, targets, [source]).select(
        *df.columns,
        F.col("size_").alias(names[0]),
        F.col("target_").alias(names[1]),
        F.least(F.floor(after) - F.floor(before), F.ceil(expected)).alias(names[2]),
    )
    return out


def emitted(sampled_rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Every row as often as it is taken, with ``copy_no`` from 1 on in place of ``copies``."""
    name = free_name(sampled_rows, "copy_no")
    times = F.when(F.col(copies) > 0, F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return sampled_rows.withColumn(name, F.explode(times)).drop(copies)
