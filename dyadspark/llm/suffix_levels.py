"""Repeated passages by a logarithmic family of sparse suffix arrays.

A string of ``WINDOW`` bytes is repeated if it starts anywhere else. Every such string contains exactly one chosen suffix
start, its anchor: the place whose first ``HEAD`` bytes have the least hash (the leftmost of equals). Equal strings have
the same anchor at the same place, so only suffixes at anchors (about one in seventy bytes) are kept, ordered by the hash
of their first ``HEAD`` bytes ("head").

* Texts come in batches. The anchored suffixes of a batch, sorted by head and counted, are its suffix array. It is
  merged with the levels of its size (and so on upwards), so the levels grow geometrically, and it is scanned against the
  larger ones. Every scan yields the heads that the new batch shares with itself or with an older level.
* Suffixes with a shared head are looked at closer. An anchor stands for a run of windows; if the text under the whole
  run ("body") occurs twice, the run is repeated. Of bodies that occur once but share their head, one text each (at most
  2 * WINDOW - HEAD bytes) is sent to its head's group, where every window is compared. Heads with very many bodies are
  compared window by window in one distributed count instead of in a group.
* Repeated windows of a text are joined to spans, and the bytes they cover are removed. All decisions rest on the input.

Texts are whole UTF-8 byte strings and windows never cross texts; a null text is empty; texts shorter than ``WINDOW``
keep everything. Equal texts are found through a 64-bit number of their bytes. Keys may repeat or be null. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm.common import mix64, small_batches, worker_cache
from dyadspark.session import stored

WINDOW, HEAD = 200, 64
SPREAD = WINDOW - HEAD  # an anchor is at most so far from its window's start
BATCHES = 4
GROUP = 20_000  # bodies of a head that one task compares
PIECE = 1_000_000  # window starts that are looked at together
PLACE_BITS = 23
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)


class Hashes:
    """Powers of the base and of its inverse, and a number for each byte."""

    def __init__(self):
        n = 2 * PIECE + 4 * WINDOW
        self.up = self.powers(BASE, n)
        self.down = self.powers(BACK, n)
        self.bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums whose differences, times ``down`` at the start, are hashes of parts."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.up[: len(data)], out=out[1:])
        return out

    def parts(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def hashes() -> Hashes:
    return worker_cache("suffix_levels", Hashes)


def anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows - 1, anchor's place in the first window, head, body) of all runs."""
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal size
        if held:
            found.append(_anchored(held))
            held.clear()
            size = 0

    for k, text in enumerate(texts):
        for at in range(0, len(text) - WINDOW + 1, PIECE):
            piece = text[at : at + PIECE + WINDOW - 1]
            held.append((k, at, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    if not found:
        return tuple(np.zeros(0, np.uint64 if c > 3 else np.int64) for c in range(6))
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchored(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    tool = hashes()
    data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
    sizes = np.array([len(h[2]) for h in held])
    ends = np.cumsum(sizes)
    sums = tool.prefix(data)
    n = len(data) - HEAD + 1
    head = mix64((sums[HEAD:] - sums[:-HEAD]) * tool.down[:n])
    order = head >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(n, dtype=np.uint64)
    width, span = 1, SPREAD + 1
    while 2 * width <= span:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if width < span:
        order = np.minimum(order[: len(order) - span + width], order[span - width :])
    place = (order & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    piece = np.repeat(np.arange(len(held)), sizes)[: len(place)]
    window = np.arange(len(place))
    valid = window + WINDOW <= ends[piece]
    window, place, piece = window[valid], place[valid], piece[valid]
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])]))
    first, last = window[fresh], window[np.append(fresh[1:], len(window)) - 1]
    place, piece = place[fresh], piece[fresh]
    length = last - first
    body = tool.parts(sums, first, last + WINDOW)
    body = mix64(body + (place - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    owner = np.array([h[0] for h in held])[piece]
    begin = first - (ends - sizes)[piece] + np.array([h[1] for h in held])[piece]
    return owner, begin, length, place - first, head[place], body


def text_number(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


# -- the index ---------------------------------------------------------------------------------------------------------


def suffix_array(df: DataFrame, text: str) -> DataFrame:
    """(head, n, fresh) of a batch, n and fresh both the number of its suffixes with that head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            head, count = np.unique(anchored(texts_of(batch.column(0)))[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(head), pa.array(count, pa.int64())], names=["head", "n"])

    return df.select(text).mapInArrow(run, "head long, n long").withColumn("fresh", F.col("n"))


class Levels:
    """The family: each level is a sorted table (head, n, fresh) over so many batches."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.shared: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Merge a batch's suffix array upwards through levels of equal size, and scan it against the larger ones."""
        size, parts = 1, [batch]
        while self.levels and self.levels[-1][0] == size:
            parts.append(self.levels.pop()[1].withColumn("fresh", F.lit(0).cast("long")))
            size *= 2
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        merged = merged.groupBy("head").agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))
        merged = stored(merged.sortWithinPartitions("head"))
        fresh = merged.where("fresh > 0")
        self.shared.append(fresh.where("n > 1").select("head"))
        for _, level in self.levels:
            self.shared.append(fresh.select("head").join(level.select("head"), "head"))
        self.levels.append((size, merged))

    def heads(self) -> DataFrame:
        """All heads that some scan found shared."""
        out = self.shared[0]
        for more in self.shared[1:]:
            out = out.unionByName(more)
        return out.distinct()


def indexed(df: DataFrame, text: str = "text", batches: int = BATCHES) -> Levels:
    """The index of all texts, batch after batch (here a batch is a share of the table by the texts' hash)."""
    family = Levels()
    for k in range(batches):
        family.add(suffix_array(df.where(F.pmod(F.xxhash64(text), F.lit(batches)) == k), text))
    return family


# -- repeated runs -----------------------------------------------------------------------------------------------------


def suffixes(df: DataFrame, text: str) -> DataFrame:
    """(text, place, head, body) of every anchored suffix; place holds first window, anchor and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            texts = texts_of(batch.column(0))
            numbers = np.array([text_number(t) for t in texts], np.int64)
            owner, begin, length, anchor, head, body = anchored(texts)
            place = begin << 32 | anchor << 20 | length
            yield pa.RecordBatch.from_arrays([pa.array(numbers[owner]), pa.array(place), signed(head), signed(body)], names=["text", "place", "head", "body"])

    return df.select(text).mapInArrow(run, "text long, place long, head long, body long")


FIRST, ANCHOR, LENGTH = "shiftright(place, 32)", "(shiftright(place, 20) & 4095)", "(place & 1048575)"


def blobs(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` with (number, n_bytes, blob): texts as numbers and compressed bytes, for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            texts = texts_of(batch.column(len(keys)))
            new = [
                pa.array([text_number(t) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *new], names=schema.names)

    new = (("number", T.LongType()), ("n_bytes", T.LongType()), ("blob", T.BinaryType()))
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(*f) for f in new)])
    return df.select(*keys, text).mapInArrow(run, schema)


def unpacked(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def cut_out(df: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(head, body, n, bodies, text, first, anchor, part): the bytes under each wanted run."""
    packed = blobs(df.where(F.octet_length(text) >= WINDOW), text, []).dropDuplicates(["number"])
    runs = wanted.groupBy("text").agg(F.collect_list(F.struct("head", "body", "n", "bodies", "place")).alias("runs"))
    both = packed.join(runs, packed["number"] == runs["text"]).select("number", "n_bytes", "blob", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = unpacked(r["blob"], r["n_bytes"])
                out = []
                for w in r["runs"]:
                    first, anchor, length = w["place"] >> 32, w["place"] >> 20 & 4095, w["place"] & 1048575
                    out.append((w["head"], w["body"], w["n"], w["bodies"], r["number"], first, anchor, data[first : first + length + WINDOW]))
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["head", "body", "n", "bodies", "text", "first", "anchor", "part"]
    return both.mapInArrow(run, "head long, body long, n long, bodies long, text long, first long, anchor long, part binary")


def window_hashes(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window within the row, hash of window and anchor's place in it) for all windows of the rows' parts."""
    tool = hashes()
    owners, offsets, codes = [], [], []
    at = 0
    while at < len(rows):
        held, size = at, 0
        while held < len(rows) and (size == 0 or size + len(rows[held]["part"]) <= PIECE):
            size += len(rows[held]["part"])
            held += 1
        parts = [r["part"] for r in rows[at:held]]
        lengths = np.array([len(p) for p in parts])
        sums = tool.prefix(np.frombuffer(b"".join(parts), np.uint8))
        counts = lengths - WINDOW + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum(lengths) - lengths, counts) + offset
        anchor = np.array([r["anchor"] for r in rows[at:held]])[owner] - offset
        code = mix64(tool.parts(sums, start, start + WINDOW) + anchor.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        owners.append(owner + at)
        offsets.append(offset)
        codes.append(code)
        at = held
    return np.concatenate(owners), np.concatenate(offsets), np.concatenate(codes)


def spans_of(row: np.ndarray, offset: np.ndarray, rows: list[dict]) -> list[tuple[int, int, int]]:
    """(text, start, end) of runs of windows; ``row`` and ``offset`` are in order."""
    if not len(row):
        return []
    fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    last = np.append(fresh[1:], len(row)) - 1
    out = []
    for a, b in zip(fresh.tolist(), last.tolist()):
        r = rows[row[a]]
        out.append((r["text"], r["first"] + int(offset[a]), r["first"] + int(offset[b]) + WINDOW))
    return out


def span_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["text", "start", "end"])


def compared(parts: DataFrame) -> DataFrame:
    """(text, start, end) of repeated windows among bodies that share their head: a group of bodies at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        out: list[tuple[int, int, int]] = []

        def flush():
            if len(rows) > 1:
                row, offset, code = window_hashes(rows)
                _, back, count = np.unique(code, return_inverse=True, return_counts=True)
                hit = count[back] > 1
                single = np.array([r["n"] == 1 for r in rows])[row]
                out.extend(spans_of(row[hit & single], offset[hit & single], rows))

        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[-1]["head"] != r["head"]:
                    flush()
                    rows = []
                if not rows or rows[-1]["body"] != r["body"]:
                    rows.append(r)
            if len(out) > 20_000:
                yield span_batch(out)
                out = []
        flush()
        if out:
            yield span_batch(out)

    dealt = parts.repartition("head").sortWithinPartitions("head", "body")
    return dealt.mapInArrow(run, "text long, start long, end long")


def counted(parts: DataFrame) -> DataFrame:
    """The same for heads with very many bodies: windows are counted over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                row, offset, code = window_hashes(rows)
                pick = lambda c: np.array([r[c] for r in rows], np.int64)[row]
                start = pick("first") + offset
                columns = [pa.array(pick("body")), pa.array(pick("n")), pa.array(pick("text")), pa.array(start), signed(code)]
                yield pa.RecordBatch.from_arrays(columns, names=["body", "n", "text", "start", "code"])

    windows = stored(parts.mapInArrow(run, "body long, n long, text long, start long, code long").dropDuplicates(["body", "start"]))
    several = windows.groupBy("code").count().where("count > 1").select("code")
    return windows.where("n = 1").join(several, "code").select("text", "start", (F.col("start") + WINDOW).alias("end"))


def repeated(df: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(number, spans): per text number the spans (start, end) that cover its repeated strings, in order. Stored."""
    long = df.where(F.octet_length(text) >= WINDOW)
    heads = indexed(long, text, batches).heads()
    marked = stored(suffixes(long, text).join(heads, "head", "left_semi"))
    bodies = marked.groupBy("body").agg(F.count("*").alias("n"), F.first("head").alias("head"), F.min(F.struct("text", "place")).alias("at"))
    bodies = stored(bodies.select("body", "n", "head", "at.text", "at.place"))
    whole = marked.join(bodies.where("n > 1").select("body"), "body", "left_semi")
    whole = whole.select("text", F.expr(FIRST).alias("start"), F.expr(f"{FIRST} + {LENGTH} + {WINDOW}").alias("end"))
    several = bodies.groupBy("head").agg(F.count("*").alias("bodies"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open")).where("bodies > 1 and open = 1")
    parts = stored(cut_out(long, bodies.join(several.select("head", "bodies"), "head"), text))
    pieces = whole.unionByName(compared(parts.where(F.col("bodies") <= GROUP)))
    if parts.where(F.col("bodies") > GROUP).take(1):
        pieces = pieces.unionByName(counted(parts.where(F.col("bodies") > GROUP)))
    return pieces.groupBy("text").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).withColumnRenamed("text", "number")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(key, n_bytes, spans, kept): every text without its repeated strings; spans are (start, end), kept is binary."""
    found = repeated(df, text, batches)
    packed = blobs(df, text, [key])
    both = packed.join(found, "number", "left").select(key, "n_bytes", "blob", "spans")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "blob", 1_000_000):
            spans, kept = [], []
            sizes, packed_ = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for size, blob, found in zip(sizes, packed_, batch.column(3).to_pylist()):
                data = unpacked(blob, size)
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                cuts = [0, *(x for s in merged for x in s), size]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                spans.append([{"start": a, "end": b} for a, b in merged])
            shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, shape), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, f"`{key}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
