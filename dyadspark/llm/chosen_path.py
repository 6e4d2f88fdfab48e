"""Jaccard join of word shingles by chosen paths.

A text is the set of its shingles of five words (letters and digits, lower case; a shorter text is one shingle). Texts
with the same set are one node, so copies are never compared. In each run a node follows a path of shingles that it
samples: the least by the run's and level's hash. Two sets of similarity s share a step with chance s, so a run that splits
buckets ``LEVELS`` times finds them with chance s ** LEVELS; runs are repeated until the target recall is reached even then.

* Buckets (nodes on one path) are split recursively by the next sampled shingle while they are large, unless the largest
  part would keep half of the bucket: such a bucket is dense, splitting it would only lose links.
* Small, dense and last-level buckets are compared by brute force with the sets themselves. A large bucket is dealt out
  as pairs of blocks, so no task gets it whole. Buckets with the same members as another are compared once.
* A pair counts in the first bucket that it shares, so links are counted, not listed. Each task returns a row per member
  with its number of links and a spanning forest; components are found from these by alternating large and small stars.

Recall at the threshold itself is at least ``RECALL`` per link in the deepest buckets and higher in all others: for 0.8
(8 runs) one step finds all but 3 in a million, two steps 0.9997, three 0.997; for 0.5 (40 runs) three steps find 0.995.
Every link found is exact (9 * common >= 4 * (a + b) for the threshold 0.8).

Null texts count as empty. A text without words is a class of its own without links. Keys may repeat or be null; copies
count as links of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm.common import free_name, mix64, small_batches
from dyadspark.llm.decontamination import numbered
from dyadspark.session import stored

WORDS = 5
LEVELS = 3
RECALL = 0.995  # chance per link of the threshold's similarity in buckets of the last level
SMALL = 64  # buckets up to this size are compared at once
BLOCK, BLOCK_TOKENS = 1024, 6_000_000  # nodes and shingles of a block of a larger bucket


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


ROLL = odd_numbers(WORDS, 9)


def runs_for(threshold: float, recall: float = RECALL) -> int:
    """The least number of runs that finds a link of the threshold's similarity with the target recall."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold lies in (0, 1], the recall between 0 and 1")
    miss = 1 - threshold**LEVELS
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text as 64-bit numbers."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, WORDS)
    sums = np.full(n - size + 1, size if size < WORDS else 0, np.uint64)
    for j in range(size):
        sums += words[j : n - size + 1 + j] * ROLL[j]
    return np.unique(mix64(sums))


def node_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def paths(found: np.ndarray, runs: int) -> np.ndarray:
    """Numbers of the paths after each level, run by run."""
    factors, shifts = odd_numbers(runs * LEVELS, 7), odd_numbers(runs * LEVELS, 8)
    least = np.empty(runs * LEVELS, np.uint64)
    for k in range(0, len(found), 20_000):
        part = found[k : k + 20_000]
        mixed = part[None, :] * factors[:, None] + shifts[:, None]
        best = mixed.min(axis=1)
        least = best if not k else np.minimum(least, best)
    steps = least.reshape(runs, LEVELS)
    out = np.empty((runs, LEVELS), np.uint64)
    path = np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for level in range(LEVELS):
        path = mix64(path ^ steps[:, level])
        out[:, level] = path
    return out.view(np.int64).ravel()


def described(df: DataFrame, key: str, text: str, runs: int) -> DataFrame:
    """(key, node, size, paths, mark) of every row; node is null for texts without words, mark a hash of the text. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            nodes, sizes, ways = [], [], []
            for words in numbered(batch.column(1).to_pylist()):
                found = shingles(words)
                nodes.append(node_of(found) if len(found) else None)
                sizes.append(len(found))
                ways.append(paths(found, runs) if len(found) else None)
            new = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(ways, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, batch.column(2)], names=schema.names)

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("node", T.BinaryType()),
                           T.StructField("size", T.LongType()), T.StructField("paths", T.ArrayType(T.LongType())),
                           T.StructField("mark", T.LongType())])
    return stored(df.select(key, text, F.xxhash64(text).alias("mark_")).mapInArrow(run, schema))


def leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """(node, size, run, leaf, members, tokens): the buckets in which each node is compared. Stored."""
    run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    now = nodes.select("node", "size", "paths", run.alias("run")).select(
        "node", "size", "run", F.slice("paths", F.col("run") * LEVELS + 1, F.lit(LEVELS)).alias("path")
    )
    done = []
    for level in range(LEVELS):
        here = F.col("path")[level]
        count = [F.count("*").alias("members"), F.sum("size").alias("tokens")]
        if level + 1 < LEVELS:
            parts = now.groupBy(here.alias("leaf"), F.col("path")[level + 1].alias("part")).agg(*count)
            sizes = parts.groupBy("leaf").agg(F.sum("members").alias("members"), F.sum("tokens").alias("tokens"), F.max("members").alias("most"))
            final = (F.col("members") <= SMALL) | (F.col("most") * 2 >= F.col("members"))
        else:
            sizes, final = now.groupBy(here.alias("leaf")).agg(*count), F.lit(True)
        sizes = sizes.where("members > 1").withColumn("final", final).select("leaf", "members", "tokens", "final")
        both = stored(now.withColumn("leaf", here).join(sizes, "leaf"))
        done.append(both.where("final").select("node", "size", "run", "leaf", "members", "tokens"))
        now = both.where("not final").select("node", "size", "run", "path")
        if level + 1 < LEVELS and not now.take(1):
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(found: DataFrame) -> DataFrame:
    """Leaves less those with the same members as another one of an earlier run."""
    mark = F.xxhash64("node").cast("decimal(20,0)")
    prints = found.groupBy("leaf").agg(F.min("run").alias("run"), F.count("*").alias("n"), F.sum(mark).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"))
    first = prints.groupBy("n", "a", "b").agg(F.min(F.struct("run", "leaf")).alias("first"))
    return found.join(first.select(F.col("first.leaf").alias("leaf")), "leaf")


def needed(nodes: DataFrame, found: DataFrame, runs: int) -> DataFrame:
    """(key, node, copies, met, targets): per node to be compared its leaf in each run and the block pairs to send it to."""
    met = found.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("met"))
    met = met.select("node", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.col("met")[r], F.lit(0))).alias("met"))
    kept = without_repeats(found)
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = kept.withColumn("blocks", F.when(F.col("members") <= SMALL, F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int"))).otherwise(blocks))
    sent = sent.withColumn("mine", mine).withColumn("other", other)
    pair = F.struct("leaf", F.col("run").cast("int").alias("run"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("block"))
    targets = sent.groupBy("node").agg(F.collect_list(pair).alias("targets"))
    return nodes.select("key", "mark", "node", "copies").join(met, "node").join(targets, "node")


def with_sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """A row per target of every wanted node with its set (sorted 32-bit numbers); repeated rows are sent again."""
    rows = df.select(F.col(key).alias("key_"), F.col(text).alias("text_"), F.xxhash64(text).alias("mark_"))
    both = rows.join(wanted, F.col("key_").eqNullSafe(F.col("key")) & (F.col("mark_") == F.col("mark"))).select("text_", "node", "copies", "met", "targets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text_", 2_000_000):
            words = numbered(batch.column(0).to_pylist())
            rest = batch.select(["node", "copies", "met", "targets"]).to_pylist()
            out: list[tuple] = []
            held = 0
            for w, r in zip(words, rest):
                found = shingles(w)
                if not len(found) or node_of(found) != r["node"]:
                    continue  # another text under the same key
                blob = np.unique(found.astype(np.uint32)).tobytes()
                mine = np.array(r["met"], "<i8").tobytes()
                for t in r["targets"]:
                    out.append((t["leaf"], t["run"], t["i"], t["j"], t["block"], r["node"], r["copies"], mine, blob))
                    held += len(blob)
                    if held > 8_000_000:
                        yield sets_batch(out)
                        out, held = [], 0
            if out:
                yield sets_batch(out)

    return both.mapInArrow(run, "leaf long, run long, i long, j long, block long, node binary, copies long, met binary, tokens binary")


def sets_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    names = ["leaf", "run", "i", "j", "block", "node", "copies", "met", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common members of every two sets, by products of 0-1 matrices over the members that several sets have."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(fresh) - 1
    several = np.bincount(number) > 1
    keep = several[number]
    column = (np.cumsum(several) - 1)[number[keep]]
    owner = owner[keep]
    out = np.zeros((n, n), np.float32)
    step = 4096
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((n, min(step, width - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def compared(rows: dict[bytes, tuple], run: int, cross: bool, threshold: Fraction) -> list[tuple[bytes, int, bytes]]:
    """(node, links, root) of the members of one block pair that have links there.

    ``rows``: node to (copies, leaves met, tokens, block). ``cross``: only pairs of different blocks.
    """
    nodes = list(rows)
    n = len(nodes)
    if n < 2:
        return []
    copies = np.array([rows[k][0] for k in nodes], np.int64)
    met = np.stack([rows[k][1] for k in nodes])
    sets = [rows[k][2] for k in nodes]
    sizes = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets)
    p, q = threshold.numerator, threshold.denominator
    linked = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    for r in range(run):  # pairs that met in an earlier run were counted there
        linked &= (met[:, None, r] != met[None, :, r]) | (met[:, None, r] == 0)
    if cross:
        block = np.array([rows[k][3] for k in nodes])
        linked &= block[:, None] != block[None, :]
    links = linked @ copies
    out, left = [], links > 0
    while left.any():
        root = int(np.argmax(left))
        inside = np.zeros(n, bool)
        inside[root] = True
        front = inside.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~inside
            inside |= front
        left &= ~inside
        top = min(nodes[k] for k in np.flatnonzero(inside))
        out += [(nodes[k], int(links[k]), top) for k in np.flatnonzero(inside)]
    return out


def links_of(sent: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from all block pairs. Stored."""
    limit = Fraction(threshold).limit_denominator(1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []

        def flush():
            if rows:
                _, r, i, j = now
                out.extend(compared(rows, r, i != j, limit))

        for batch in batches:
            for r in batch.to_pylist():
                here = (r["leaf"], r["run"], r["i"], r["j"])
                if here != now:
                    flush()
                    now, rows = here, {}
                met = np.frombuffer(r["met"], "<i8")
                rows[r["node"]] = (r["copies"], met, np.frombuffer(r["tokens"], np.uint32), r["block"])
            if len(out) > 10_000:
                yield links_batch(out)
                out.clear()
        flush()
        if out:
            yield links_batch(out)

    # Both blocks of a pair arrive together; which of them a member is from decides what it is compared with.
    by = ["leaf", "run", "i", "j"]
    blocks = sent.repartition(*by).sortWithinPartitions(*by)
    return stored(blocks.mapInArrow(run, "node binary, links long, root binary"))


def links_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, top): the least node of each node's component, from (node, root) edges. Stored.

    Large stars hang every larger neighbour of a node below the least one around it, small stars every smaller one; a
    round is two aggregations and two joins, and the number of rounds grows with the logarithm of the component size.
    """
    now = stored(edges.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.where("u <> v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("top"))
        mark = new
    raise RuntimeError("components did not settle")


def classes(df: DataFrame, key: str, text: str, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows as (key, node) and nodes as (node, top, class_id, n_links); ``top`` names the class. Both stored."""
    runs = runs_for(threshold, recall)
    rows = described(df, key, text, runs)
    known = rows.where("node is not null")
    first = F.min(F.struct(F.col("key").isNull().alias("gap"), "key", "mark")).alias("first")  # null keys last
    nodes = known.groupBy("node").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"))
    nodes = stored(nodes.withColumns({"key": F.col("first.key"), "mark": F.col("first.mark")}).drop("first"))
    found = leaves(nodes, runs)
    links = links_of(with_sets(df, needed(nodes, found, runs), key, text), threshold)
    tops = components(links)
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    described_nodes = nodes.select("node", "key", "copies").join(count, "node", "left").join(tops, "node", "left")
    described_nodes = stored(described_nodes.withColumn("top", F.coalesce("top", "node")))
    least = described_nodes.groupBy("top").agg(F.min("key").alias("class_id"))
    links_all = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return rows.select("key", "node"), described_nodes.join(least, "top").select("node", "top", "class_id", links_all)


def joined(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links) of every row: the least key of its component, and the number of rows it is linked to."""
    rows, place = classes(df, key, text, threshold, recall)
    both = rows.join(place, "node", "left")
    alone = F.col("node").isNull()
    return both.select(
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def with_nodes(df: DataFrame, text: str, name: str) -> DataFrame:
    """All columns of ``df`` and the node of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            sets = map(shingles, numbered(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def one_per_class(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` that stay: of each class those with the least key (null keys are the greatest), then the least set.

    Rows are decided on one by one, by key and set of shingles: of rows with one key some may stay and others go. Rows
    that repeat with one key and one set count as one document and stay together; rows without words stay.
    """
    rows, place = classes(df, key, text, threshold, recall)
    documents = rows.where("node is not null").distinct().join(place.select("node", "top"), "node")
    rank = F.struct(F.col("key").isNull().alias("gap"), "key", "node")
    best = documents.groupBy("top").agg(F.min(rank).alias("best"))
    marked = documents.join(best, "top").select("key", "node", (F.col("node") != F.col("best.node")) | ~F.col("key").eqNullSafe(F.col("best.key")))
    marked = stored(marked.toDF("key", "node", "gone"))
    gone = marked.where("gone").select(F.col("key").alias("key_"), F.col("node").alias("node_"))
    staying = marked.where("not gone").select("key").union(rows.where("node is null").select("key")).distinct()
    mixed = stored(gone.join(staying, F.col("key_").eqNullSafe(F.col("key")), "left_semi"))  # keys of which only some rows go
    same = F.col(key).eqNullSafe(F.col("key_"))
    if mixed.isEmpty():
        return df.join(gone.select("key_").distinct(), same, "left_anti")
    keys = stored(mixed.select("key_").distinct())
    clear = gone.select("key_").distinct().join(keys.withColumnRenamed("key_", "mixed_"), F.col("key_").eqNullSafe(F.col("mixed_")), "left_anti")
    sure = df.join(keys, same, "left_anti").join(clear, same, "left_anti")
    name = free_name(df, "node")
    some = with_nodes(df.join(keys, same, "left_semi"), text, name)
    return sure.unionByName(some.join(mixed, same & F.col(name).eqNullSafe(F.col("node_")), "left_anti").drop(name))
