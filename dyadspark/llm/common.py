"""What the operators of this folder share: reading, batches, worker-side caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str, make: Callable):
    """An object that the Python worker keeps for later tasks, until another one is asked for: one is held at a time."""
    box = sys.modules.setdefault("dyadspark_worker", types.ModuleType("dyadspark_worker"))
    if getattr(box, "held", (None,))[0] != name:
        box.held = None
        box.held = (name, make())
    return box.held[1]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most (single longer rows stay whole)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


BLANK = np.isin(np.arange(256), [32, *range(9, 14)])  # the bytes of white space: U+0020 and U+0009 to U+000D


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each text starts and the last one ends; null texts are empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    if not len(whole) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (stretches without ``blank`` bytes, never across texts), and each text's first word."""
    solid = ~blank[data]
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes[:-1] &= ~solid[1:]
    filled = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][filled], bounds[1:][filled] - 1
    begins[first], finishes[last] = solid[first], solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, bounds)


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> pa.Array:
    """The words that ``word_bounds`` found, as one array."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[~blank[data]]))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores where the table has such a column already (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (multiply and shift), for hash values whose low bits are weak."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hash_sample(df: DataFrame, columns: list[str], n: int, total: int) -> DataFrame:
    """The ``n`` rows with the least hash of ``columns``, of about ``total``.

    A threshold on the hash passes about twice as many rows, so little is sorted however many partitions there are.
    """
    mixed = F.xxhash64(*[F.col(c) for c in columns])
    marked = df.withColumn("mixed_", mixed)
    if total > 4 * n + 1000:
        marked = marked.where(F.col("mixed_") < -(1 << 63) + int((2 * n + 500) / total * (1 << 64)))
    return marked.orderBy("mixed_", *columns).limit(n).drop("mixed_")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents``; a null text counts as empty."""
    df = table(spark, sf_dir, "documents")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns])
