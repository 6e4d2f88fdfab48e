"""Quality without labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

1. One pass over the texts gives each document its votes and its hashed features (shapes of words, pairs of shapes,
   binned shares). Whole texts are read.
2. Votes are counted by pattern (at most 3 ** labellers rows); on these counts expectation-maximisation finds how often
   each labeller says junk, nothing or prose in either class, and so the posterior of every pattern. A labeller's rate of
   false alarms is drawn towards a small prior, but one that often calls prose junk is found out and counts less.
3. A bounded sample of documents (``SAMPLE``, by a hash of key and features, so it does not depend on partitions) trains
   a logistic scorer on the posteriors; every document is scored.

Null and empty texts have no word: all labellers abstain and the scorer decides by the corpus's share. Repeated rows get
equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm.bpe import ChunkCache
from dyadspark.llm.common import hash_sample, mix64, small_batches, worker_cache
from dyadspark.session import stored

BUCKETS = 4096
SAMPLE = 20_000  # documents that train the scorer
JUNK, NONE, PROSE = 0, 1, 2
#: Prior of how often a labeller calls prose junk (the limits below are far from prose), and its weight against the votes
#: on prose. It is a share of them, so estimates do not depend on the number of documents.
FALSE_ALARM, PRIOR = 0.003, 1.0
PIECE = 4096  # words within which repeats are looked for, so that long texts are judged like short ones
MARKS = re.compile(r"[#$%&*|!^~<>{}=+@\\_]")
#: Each labeller: a share, and from where on it says junk or prose (either side may be the high one); shares between
#: the two limits and texts of fewer words than the last number get no vote.
LABELLERS = [
    ("marks", 0.045, 0.02, 3),
    ("same_as_last", 0.20, 0.08, 12),
    ("repeated_pairs", 0.45, 0.25, 20),
    ("distinct", 0.35, 0.50, 20),
    ("capitals", 0.45, 0.20, 3),
    ("same_lines", 0.60, 0.35, 20),
    ("marked_words", 0.35, 0.12, 5),
]


def shape(chunk: str) -> str:
    """Letters as ``a`` or ``A``, digits as 1, marks as they are; runs once."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "1" if c.isdigit() else c for c in chunk)
    out = ""
    for k in kinds:
        if not out.endswith(k):
            out += k
    return out


def entry(chunk: str) -> bytes:
    """Identity, shape bucket, letters and marks, capitals, marks of one chunk."""
    if not chunk:
        return b""
    marks = len(MARKS.findall(chunk))
    numbers = (
        zlib.crc32(chunk.encode("utf-8", "surrogatepass")),
        zlib.crc32(shape(chunk).encode("utf-8", "surrogatepass")),
        len(chunk),
        sum(map(str.isupper, chunk)),
        marks,
    )
    return np.array(numbers, "<u4").tobytes()


def shares(words: np.ndarray, text: str) -> dict[str, float]:
    """What the labellers look at; ``words`` has a row per chunk as made by ``entry``."""
    n = len(words)
    if not n:
        return {name: 0.0 for name, *_ in LABELLERS}
    ids = words[:, 0].astype(np.uint64)
    letters = max(1, int(words[:, 2].sum()))
    piece = np.arange(n, dtype=np.uint64) // np.uint64(PIECE)
    pairs = mix64(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) + piece[1:]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "marks": float(words[:, 4].sum()) / letters,
        "same_as_last": float(np.count_nonzero(ids[1:] == ids[:-1])) / n,
        "repeated_pairs": 1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0,
        "distinct": len(np.unique(ids | piece << np.uint64(32))) / n,
        "capitals": float(words[:, 3].sum()) / letters,
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        "marked_words": float(np.count_nonzero(words[:, 4])) / n,
    }


def votes(seen: dict[str, float], n: int) -> int:
    """The votes of all labellers as one number in base three."""
    code = 0
    for name, junk, prose, least in LABELLERS:
        x, turn = seen[name], 1 if junk > prose else -1
        vote = NONE if n < least else JUNK if turn * x >= turn * junk else PROSE if turn * x <= turn * prose else NONE
        code = 3 * code + vote
    return code


def features(words: np.ndarray, seen: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shapes and pairs of shapes by the root of their share, and a bucket per binned share."""
    n = len(words)
    binned = [zlib.crc32(f"{k}:{min(19, int(v * 20))}".encode()) for k, v in seen.items()]
    binned.append(zlib.crc32(f"words:{n.bit_length()}".encode()))
    if n:
        shapes = words[:, 1].astype(np.uint64)
        mixed = ((shapes[:-1] * np.uint64(31) + shapes[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        found, counts = np.unique(np.concatenate([shapes % np.uint64(BUCKETS), mixed % np.uint64(BUCKETS)]), return_counts=True)
        values = np.sqrt(counts / n)
        strong = values >= 0.05
        found, values = found[strong].astype(np.int64), values[strong]
    else:
        found, values = np.zeros(0, np.int64), np.zeros(0)
    places = np.concatenate([found, np.array(binned, np.int64) % BUCKETS])
    return places.astype(np.int32), np.concatenate([values, np.full(len(binned), 0.5)]).astype(np.float32)


def read(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Votes, buckets and values of each text."""
    cache = worker_cache("weak_labels", lambda: ChunkCache(lambda chunks: list(map(entry, chunks)), None, simple=False))
    texts = [t or "" for t in column.to_pylist()]
    for text, entries in zip(texts, cache.lines(texts)):
        words = np.frombuffer(b"".join(entries), "<u4").reshape(-1, 5)
        seen = shares(words, text)
        yield votes(seen, len(words)), *features(words, seen)


def described(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``votes`` long, ``places`` and ``amounts`` of every document. Stored."""
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("votes", T.LongType()),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("amounts", T.ArrayType(T.FloatType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            codes, places, amounts = zip(*read(batch.column(len(keys))))
            new = [pa.array(codes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(amounts, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *new], names=[*keys, "votes", "places", "amounts"])

    return stored(df.select(*keys, text).mapInArrow(run, schema))


def expectation_maximisation(counts: dict[int, int], steps: int = 500) -> dict[int, float]:
    """Posterior of prose for each pattern of votes."""
    if not counts:
        return {}
    m = len(LABELLERS)
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes.tolist()], float)
    said = np.stack([codes // 3 ** (m - 1 - k) % 3 for k in range(m)], axis=1)
    junk, prose = (said == JUNK).sum(1), (said == PROSE).sum(1)
    good = np.where(junk > 0, 0.02, np.where(prose > 0, 0.95, 0.5))  # what any labeller calls junk starts as junk
    for _ in range(steps):
        share = (weight @ good + 1) / (weight.sum() + 2)
        log = np.tile(np.log([1 - share, share]), (len(codes), 1))
        for k in range(m):
            for c, p in ((0, 1 - good), (1, good)):
                table = np.array([(weight * p)[said[:, k] == v].sum() + 0.5 for v in range(3)])
                # Abstaining says nothing about the class.
                voted = table[[JUNK, PROSE]] / (table[JUNK] + table[PROSE])
                if c:
                    alarm = (voted[0] + PRIOR * FALSE_ALARM) / (1 + PRIOR)
                    voted = np.array([alarm, 1 - alarm])
                log[:, c] += np.log(np.array([voted[0], 1.0, voted[1]]))[said[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        moved = np.abs(new - good).max()
        good = new
        if moved < 1e-9:
            break
    return dict(zip(codes.tolist(), good.tolist()))


def train(places: list[np.ndarray], amounts: list[np.ndarray], target: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic model with a small ridge, by accelerated gradient steps."""
    weights = np.zeros(BUCKETS + 1)
    if not len(target):
        return weights
    sizes = np.array([len(p) for p in places])
    row, col, val = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(places), np.concatenate(amounts).astype(float)
    share = np.clip(target.mean(), 0.02, 0.98)
    importance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    importance /= importance.sum()
    rate, ahead, last = 4.0, weights.copy(), weights.copy()
    for step in range(steps):
        score = np.bincount(row, val * ahead[col], len(sizes)) + ahead[-1]
        miss = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) * importance
        gradient = np.append(np.bincount(col, val * miss[row], BUCKETS), miss.sum()) + 1e-5 * ahead
        weights = ahead - rate * gradient
        ahead = weights + step / (step + 3) * (weights - last)
        last = weights
    return weights


def fitted(seen: DataFrame, key: str, sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, float]]:
    """Weights of the scorer and posterior of each pattern of votes."""
    counts = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** labellers
    posterior = expectation_maximisation(counts)
    total = sum(counts.values())
    rows = hash_sample(seen.select(F.col(key).cast("string").alias("name"), "votes", "places", "amounts"), ["name", "votes", "places"], sample, total)
    rows = rows.select("votes", "places", "amounts").toArrow()
    weights = train(
        [np.asarray(x, np.int64) for x in rows.column("places").to_pylist()],
        [np.asarray(x, float) for x in rows.column("amounts").to_pylist()],
        np.array([posterior[v] for v in rows.column("votes").to_pylist()]),
    )
    return weights, posterior


def probability(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(sums + weights[-1], -40, 40)))


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, posterior, score, kept) of every document: the weak label, the scorer's probability of prose, and its decision."""
    seen = described(df, [key], text)
    sent = df.sparkSession.sparkContext.broadcast(fitted(seen, key, sample))  # both parts of fixed size
    new_fields = (("posterior", T.DoubleType()), ("score", T.DoubleType()), ("kept", T.BooleanType()))
    schema = T.StructType([seen.schema[key], *(T.StructField(*f) for f in new_fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = sent.value
        for batch in batches:
            at, of = batch.column(2), batch.column(3)
            ends = np.asarray(at.offsets, np.int64) - at.offsets[0].as_py()
            sums = np.concatenate([[0.0], np.cumsum(weights[np.asarray(at.flatten())] * np.asarray(of.flatten(), float))])
            score = probability(weights, sums[ends[1:]] - sums[ends[:-1]])
            label = [posterior[v] for v in batch.column(1).to_pylist()]
            new = [pa.array(label, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=schema.names)

    return seen.mapInArrow(run, schema)


def prose_only(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df`` that the scorer keeps, with all columns. The texts are read twice and never shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(fitted(described(df, [key], text), key, sample)[0])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in small_batches(batches, text):
            sums = [float(weights[at] @ of) for _, at, of in read(batch.column(place))]
            yield batch.filter(pa.array(probability(weights, np.array(sums)) >= 0.5))

    return df.mapInArrow(run, df.schema)
