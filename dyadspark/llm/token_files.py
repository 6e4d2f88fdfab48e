"""Token-id files with directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids
that need one, and so on; a bitmap per level says which ids go on, and a directory counts the set bits before each
block of the bitmap. Any id is read by one look-up per level, without decoding what stands before it.

File layout (little-endian; all offsets from the start of the file):
``DACIDS01``, header length (u64), header (JSON: documents, tokens, levels with offsets), document keys (i64), a byte per
key (1: null), token start of each document and of the end (u64), then for each level codes (u8), bitmap (least bit
first), directory (u64 per block of 512 bits).

Files are written by the tasks straight to the shared folder under a temporary name and then renamed, so a repeated
task replaces its file by the same bytes. Order: ascending key, nulls first, repeated keys by their text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.llm.bpe import END, NO_BYTES, ChunkTable
from dyadspark.llm.common import small_batches, worker_cache
from dyadspark.session import scratch_path, stored

MAGIC = b"DACIDS01"
BLOCK = 512  # bits between two counts of the directory
TOGETHER = 1000  # words that the library gets in one text
FILE_TOKENS = 4_000_000  # a task starts a new file beyond that many ids


# -- codes -------------------------------------------------------------------------------------------------------------


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, bitmap and directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(1, len(bits)) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        out.append(((rest & 255).astype(np.uint8), bits, rank))
        if not more.any():
            return out
        rest = rest[more] >> np.uint32(8)


def file_bytes(keys: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    known = np.array([0 if k is None else k for k in keys], "<i8")
    null = np.array([k is None for k in keys], np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    parts = [known.tobytes(), null.tobytes(), starts.tobytes()]
    shape = []
    for codes, bits, rank in levels_of(ids):
        shape.append([len(codes), len(bits), len(rank)])
        parts += [codes.tobytes(), bits.tobytes(), rank.astype("<u8").tobytes()]
    header = json.dumps({"documents": len(keys), "tokens": int(len(ids)), "levels": shape}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *parts])


class TokenFile:
    """Random access to one file; only the bytes that a request needs are read."""

    def __init__(self, source):
        self.source = source
        self._seek(0)
        if source.read(8) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(source.read(8), "little")
        header = json.loads(source.read(size))
        self.documents, self.tokens = header["documents"], header["tokens"]
        at, n = 16 + size, header["documents"]
        self._keys, self._nulls, self._starts = at, at + 8 * n, at + 9 * n
        at += 9 * n + 8 * (n + 1)
        self.levels = []
        for codes, bits, rank in header["levels"]:
            self.levels.append((codes, at, at + codes, at + codes + bits))
            at += codes + bits + 8 * rank

    def _seek(self, at: int) -> None:
        self.source.seek(at)

    def _read(self, at: int, size: int) -> bytes:
        self._seek(at)
        return self.source.read(size)

    def keys(self, first: int, last: int) -> list[int | None]:
        known = np.frombuffer(self._read(self._keys + 8 * first, 8 * (last - first)), "<i8")
        null = np.frombuffer(self._read(self._nulls + first, last - first), np.uint8)
        return [None if z else int(k) for k, z in zip(known, null)]

    def starts(self, first: int, last: int) -> np.ndarray:
        """Token starts of documents ``first`` to ``last``, both included (the last may be the end)."""
        return np.frombuffer(self._read(self._starts + 8 * first, 8 * (last - first + 1)), "<u8").astype(np.int64)

    def _bits(self, level: int, first: int, last: int) -> np.ndarray:
        at = self.levels[level][2]
        raw = np.frombuffer(self._read(at + first // 8, -(-last // 8) - first // 8), np.uint8)
        return np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + last - first].astype(bool)

    def _rank(self, level: int, place: int) -> int:
        """Set bits before ``place``."""
        block = place // BLOCK
        before = int.from_bytes(self._read(self.levels[level][3] + 8 * block, 8), "little")
        return before + int(self._bits(level, block * BLOCK, place).sum()) if place % BLOCK else before

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (excluded) of the file."""
        out = np.zeros(last - first, np.uint32)
        where, level = np.arange(last - first), 0
        while last > first:
            codes = np.frombuffer(self._read(self.levels[level][1] + first, last - first), np.uint8)
            out[where] |= codes.astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.levels):
                break
            more = self._bits(level, first, last)
            where, first = where[more], self._rank(level, first)
            last, level = first + len(where), level + 1
        return out


# -- writing and reading -----------------------------------------------------------------------------------------------


def library_encoder(path: str):
    """Pieces of chunks to their ids by the tokenizers library.

    Pieces that are one word (or one run of marks) go to the library many at a time, as one text; the word ends among the
    tokens part them again. Where their number does not fit, and for all other pieces, each piece is a text of its own.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    names = tokenizer.get_vocab(with_added_tokens=True)
    closing = np.zeros(max(names.values()) + 1, bool)
    closing[[i for name, i in names.items() if name.endswith(END)]] = True

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(pieces: list[str], plain: np.ndarray) -> list[pa.Array]:
        out, single = [b""] * len(pieces), np.flatnonzero(~plain).tolist()
        words = [k for k in np.flatnonzero(plain).tolist() if pieces[k]]
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for group, found in zip(groups, ids([" ".join([pieces[k] for k in g]) for g in groups])):
            ends = 4 * (np.flatnonzero(closing[found]) + 1)
            if len(ends) != len(group):
                single += group
                continue
            raw, start = found.tobytes(), 0
            for k, end in zip(group, ends.tolist()):
                out[k] = raw[start:end]
                start = end
        for k, found in zip(single, ids([pieces[k] for k in single])):
            out[k] = found.tobytes()
        return [pa.array(out, pa.large_binary())]

    return encode


def write_tokens(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``, below ``folder``; returns one row per file, stored.

    Rows: ``shard``, ``part`` (order of the files), ``file``, ``documents``, ``tokens``. A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(f"lib:{path}", lambda: ChunkTable(library_encoder(path), [NO_BYTES], size=400_000))
        shard, part = TaskContext.get().partitionId(), 0
        keys, sizes, parts, held = [], [], [], 0
        end = int(end_id).to_bytes(4, "little")

        def flush():
            nonlocal part, keys, sizes, parts, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"{folder}/{shard:06d}-{part:06d}.dac"
            put(name, file_bytes(keys, sizes, ids))
            row = {"shard": [shard], "part": [part], "file": [name], "documents": [len(keys)], "tokens": [len(ids)]}
            part, keys, sizes, parts, held = part + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in small_batches(batches, text):
            keys_now = batch.column(batch.schema.get_field_index(key)).to_pylist()
            (found,) = table.joined(batch.column(batch.schema.get_field_index(text)))
            for k, ids in zip(keys_now, found.to_pylist()):
                ids += end
                keys.append(k)
                sizes.append(len(ids) >> 2)
                parts.append(ids)
                held += len(ids) >> 2
                if held >= FILE_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    # The texts' first letters spread rows of one key (or without a key) over several partitions.
    by_key = F.col(key).asc_nulls_first()
    ordered = df.select(key, text).repartitionByRange(by_key, F.substring(text, 1, 64)).sortWithinPartitions(by_key, text)
    return stored(ordered.mapInArrow(run, "shard long, part long, file string, documents long, tokens long"))


def place_of(uri: str):
    """File system and path of a location that may carry a scheme."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    store, path = place_of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, path)


def open_tokens(uri: str) -> TokenFile:
    store, path = place_of(uri)
    return TokenFile(store.open_input_file(path))


def read_tokens(files: DataFrame, step: int = 256) -> DataFrame:
    """Rows (doc_id, start, n_tokens, token_ids) of all files; start counts over the files in order.

    The starts of the files are sums over one row per file; the ids are read by ranges of documents.
    """
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    ranges = placed.select("file", "base", F.explode(F.expr(f"sequence(0L, documents - 1, {step}L)")).alias("first"), "documents")
    # Rows only point to ids, so their size says nothing about the work: as many tasks as files, whatever their size.
    ranges = ranges.repartition(max(1, files.count()), "file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = open_tokens(row["file"])
                first, last = row["first"], min(row["documents"], row["first"] + step)
                starts = source.starts(first, last)
                ids = source.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                cuts = starts - starts[0]
                blobs = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(source.keys(first, last), pa.int64()),
                        pa.array(starts[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "token_ids"],
                )

    return ranges.mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
