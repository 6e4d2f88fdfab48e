"""Benchmark passages in texts within an edit budget: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

Texts and items are sequences of words (letters and digits, lower case). An item of m words may differ by k = m // 5
word edits (similarity 0.8). It is split into k + 1 pieces; k edits cannot touch all of them, so every occurrence has an
exact hit of some piece. Hits are found by rolling hashes of the pieces' lengths; around them the least distance of the
item to any part of the text is computed with bit vectors, one step per word. Windows of one item that overlap are
scanned once, so repeated words cost linear time.

Items are taken in blocks of at most ``BLOCK`` (the only data that are broadcast); every block meets all texts, whole.
Null or wordless texts and items match nothing; several items with one text all match; repeated rows are judged alike.
An empty table of items finds nothing, an empty table of texts gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.bpe import ChunkCache
from dyadspark.llm.common import free_name, mix64, small_batches, worker_cache
from dyadspark.session import stored

BLOCK = 20_000  # items that are broadcast at a time
WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
FILTER_BITS = 22


def entry(chunk: str) -> bytes:
    """A 64-bit number for each word of a chunk."""
    return b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in WORD.findall(chunk.lower()))


def numbered(texts: list[str | None]) -> list[np.ndarray]:
    cache = worker_cache("decontamination", lambda: ChunkCache(lambda chunks: list(map(entry, chunks)), bytes.__add__))
    return [np.frombuffer(b"".join(e), "<u8") for e in cache.lines([t or "" for t in texts])]


def budget(m: int) -> int:
    return m // 5


def pieces(m: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 pieces of an item of m words."""
    cuts = np.linspace(0, m, budget(m) + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def least_distance(positions: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least number of edits between the item and any part of ``text``, and where that part ends.

    ``positions`` has a bit per place for each word of the item. Vertical differences of the distance table are kept in
    two bit vectors (one more, one less); a row's start costs nothing, so the item may begin anywhere.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    more, less, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(text, 1):
        equal = positions.get(word, 0)
        vertical = equal | less
        horizontal = (((equal & more) + more) ^ more) | equal
        up = less | ~(horizontal | more) & full
        down = more & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        more = down | ~(vertical | up) & full
        less = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """Piece hashes and bit positions of a block of items."""

    def __init__(self, keys: list, texts: list[str | None]):
        self.keys, self.words = keys, numbered(texts)
        self.positions: list[dict[int, int]] = []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, words in enumerate(self.words):
            places: dict[int, int] = {}
            for at, w in enumerate(words.tolist()):
                places[w] = places.get(w, 0) | 1 << at
            self.positions.append(places)
            if len(words):
                for start, size in pieces(len(words)):
                    code = sum(w * pow(BASE, j, 1 << 64) for j, w in enumerate(words[start : start + size].tolist())) & MASK
                    found.setdefault(size, {}).setdefault(code, []).append((k, start))
        self.by_size = {}
        for size, codes in sorted(found.items()):
            mixed = np.zeros(1 << FILTER_BITS, bool)
            mixed[(mix64(np.array(list(codes), np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_size[size] = (mixed, codes)

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, item, place where the item would begin) of every exact hit of a piece."""
        if not texts or not self.by_size:
            return
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        flat = np.concatenate(texts)
        if not len(flat):
            return
        left = np.repeat(ends, sizes) - np.arange(len(flat))  # words to the end of the own text
        rolling, factor = np.zeros(len(flat), np.uint64), 1
        for size in range(1, max(self.by_size) + 1):
            rolling = rolling[: len(flat) - size + 1] + flat[size - 1 :] * np.uint64(factor)
            factor = factor * BASE & MASK
            if size not in self.by_size or not len(rolling):
                continue
            mixed, codes = self.by_size[size]
            maybe = np.flatnonzero(mixed[(mix64(rolling) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            for at in maybe[left[maybe] >= size].tolist():
                for item, start in codes.get(int(rolling[at]), ()):
                    text = int(np.searchsorted(ends, at, side="right"))
                    yield text, item, at - int(ends[text] - sizes[text]) - start

    def found(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
        """{(text, item): (edits, end word)} of all items within their budget."""
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for text, item, begin in self.hits(texts):
            m = len(self.words[item])
            slack = budget(m)
            windows.setdefault((text, item), []).append((max(0, begin - slack), begin + m + slack))
        out = {}
        for (text, item), spans in windows.items():
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            m = len(self.words[item])
            best = (m + 1, 0)
            for a, b in merged:
                edits, end = least_distance(self.positions[item], m, texts[text][a:b].tolist())
                best = min(best, (edits, a + end))
            if best[0] <= budget(m):
                out[text, item] = best
        return out


def blocks_of(items: DataFrame, key: str, text: str, block: int) -> Iterator[tuple[list, list]]:
    """Keys and texts of the items, block by block."""
    items = items.select(key, text)
    number = -(-items.count() // block)
    for k in range(number):
        rows = items.where(F.pmod(F.xxhash64(key, text), F.lit(number)) == k) if number > 1 else items
        got = rows.toArrow()
        yield got.column(key).to_pylist(), got.column(text).to_pylist()


MATCH = "array<struct<item_id:long,edits:long,end_word:long>>"


def matched(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, matches) of every text: the items it holds with the number of edits and the place of the last word.

    Matches are in the order of items, edits and places. Rows are known by a number, never by their key, which may be null
    or shared by different texts; so the number of blocks does not change any row's matches.
    """
    spark = df.sparkSession
    rows, number = df.select(key, text), key
    if items.count() > block:
        number = free_name(rows, "row")
        rows = stored(rows.withColumn(number, F.monotonically_increasing_id()))
    kind = rows.schema[number].dataType.simpleString()
    parts = []
    for keys, texts in blocks_of(items, item_key, item_text, block):
        sent = spark.sparkContext.broadcast((keys, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items(*sent.value)
            for batch in small_batches(batches, text):
                out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for (at, item), (edits, end) in known.found(numbered(batch.column(1).to_pylist())).items():
                    out[at].append({"item_id": known.keys[item], "edits": edits, "end_word": end})
                shape = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("end_word", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], names=[number, "matches"])

        parts.append(rows.select(number, text).mapInArrow(run, f"`{number}` {kind}, matches {MATCH}"))
    if not parts:
        return df.select(key, F.expr(f"cast(array() as {MATCH})").alias("matches"))
    if len(parts) == 1:
        return parts[0].withColumn("matches", F.array_sort("matches"))
    # Several blocks: only rows with a match go on, and each is joined to its text by its number.
    found = reduce(DataFrame.unionByName, parts).where(F.size("matches") > 0)
    lists = stored(found.groupBy(number).agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")))
    none = F.expr(f"cast(array() as {MATCH})")
    return rows.select(number, key).join(lists, number, "left").select(key, F.coalesce("matches", none).alias("matches"))


def clean_only(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that hold no item, with all columns; each block of items filters what the last one left."""
    spark = df.sparkSession
    place = df.columns.index(text)
    for keys, texts in blocks_of(items, item_key, item_text, block):
        sent = spark.sparkContext.broadcast((keys, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items(*sent.value)
            for batch in small_batches(batches, text):
                clean = np.ones(batch.num_rows, bool)
                for at, _ in known.found(numbered(batch.column(place).to_pylist())):
                    clean[at] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(run, df.schema)
    return df
