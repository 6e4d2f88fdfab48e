"""Toxic passages as maximum-scoring segments of token log-odds.

1. One pass counts hashed tokens (each word, and its beginnings of four and five letters) over all documents and over
   the labelled ones by class. Log-odds of the classes with an informative Dirichlet prior (the corpus's own shares) are
   taken a standard error towards zero, less an offset, so that ordinary words score below zero.
2. A linear-time scan finds all maximal segments of every text; only runs of positive words need a step of the scan.
3. The best segments of harmless labelled documents give the extreme-value law of what chance alone reaches in a text of
   n words. Every segment that this law finds significant counts with its surprise; their sum is the document's evidence.
4. The evidence is turned into a probability by the labelled documents' rate, kept rising (pooled neighbours).

Labels come from a bounded sample (``SAMPLE`` rows by hash), so they are broadcast and the texts are never shuffled.
Null and empty texts have no evidence and get the rate of such documents. A null key is never labelled. Several labels of
one key count as the largest. Rows may repeat. An empty table gives an empty result; without labels all score 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.bpe import ChunkCache
from dyadspark.llm.common import hash_sample, small_batches, worker_cache
from dyadspark.session import stored

SAMPLE = 200_000  # labelled documents that are learned from at most
BITS = 18
PARTS = 3  # a word and its beginnings of five and four letters
SIZE = PARTS << BITS
PRIOR = 500.0  # weight of the corpus's shares, in tokens
OFFSET = 1.0
ROUNDS = 30  # of the scale of the extreme-value law; each needs the last one's scale, and all follow from the same five moments
WORD = re.compile(r"[^\W\d_]+")


def entry(chunk: str) -> bytes:
    """Token numbers of each word of a chunk: one row of ``PARTS`` numbers per word."""
    out = []
    for word in WORD.findall(chunk.lower()):
        for part, piece in enumerate((word, word[:5], word[:4])):
            code = zlib.crc32(piece.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
            out.append(part << BITS | code)
    return np.array(out, "<u4").tobytes()


def words_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Token numbers of each text, a row per word."""
    cache = worker_cache("toxicity", lambda: ChunkCache(lambda chunks: list(map(entry, chunks)), bytes.__add__))
    for entries in cache.lines([t or "" for t in column.to_pylist()]):
        yield np.frombuffer(b"".join(entries), "<u4").reshape(-1, PARTS)


def counted(df: DataFrame, text: str, label: str) -> DataFrame:
    """(token, harmless, toxic, everywhere): token counts of labelled documents by class and of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, SIZE), np.int64)
        for batch in batches:
            for part in small_batches(iter([batch]), text):
                classes = part.column(1).to_pylist()
                found: list[list[np.ndarray]] = [[], [], []]
                for label_, words in zip(classes, words_of(part.column(0))):
                    found[2 if label_ is None else int(label_ > 0)].append(words)
                for k in range(3):
                    if found[k]:
                        sums[k] += np.bincount(np.concatenate(found[k]).ravel(), minlength=SIZE)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(sums[k][used], pa.int64()) for k in range(3))],
            names=["token", "harmless", "toxic", "rest"],
        )

    parts = df.select(text, label).mapInArrow(run, "token long, harmless long, toxic long, rest long")
    total = F.sum("harmless") + F.sum("toxic") + F.sum("rest")
    return parts.groupBy("token").agg(F.sum("harmless").alias("harmless"), F.sum("toxic").alias("toxic"), total.alias("everywhere"))


def weights(token: np.ndarray, harmless: np.ndarray, toxic: np.ndarray, everywhere: np.ndarray) -> np.ndarray:
    """Score of every token number; tokens that no label has met score as the prior says, less the offset."""
    out = np.full(SIZE, -OFFSET)
    for part in range(PARTS):
        mine = token >> BITS == part
        y0, y1, all_ = harmless[mine].astype(float), toxic[mine].astype(float), everywhere[mine].astype(float)
        if not len(all_) or not y1.sum() or not y0.sum():
            continue
        prior = PRIOR * all_ / all_.sum() + 0.5
        n0, n1 = y0.sum() + prior.sum(), y1.sum() + prior.sum()
        delta = np.log((y1 + prior) / (n1 - y1 - prior)) - np.log((y0 + prior) / (n0 - y0 - prior))
        error = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        known = y1 >= 4
        lower = np.where(known, delta - error, np.minimum(delta, 0.0))
        out[token[mine]] = np.clip(lower, -3.0, 8.0) - OFFSET
    return out


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first word, word after the last) in linear time.

    Kept segments have a left sum (before) and right sum (through); a new run is joined to the nearest kept segment with
    a smaller left sum if that one's right sum is smaller than its own.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    running = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []
    lower: list[int] = []  # for each kept segment, the nearest kept one with a smaller left sum, or -1
    for first, last in zip(begins.tolist(), ends.tolist()):
        left, right = running[first], running[last]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = lower[j]
            if j < 0 or kept[j][1] >= right:
                kept.append([left, right, first, last])
                lower.append(j)
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:], lower[j:]
    return [(float(r - b), f, e) for b, r, f, e in kept]


def scanned(df: DataFrame, table: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, label, n_words, best, spans): the segments of every text as (score, first, last). Stored."""
    sent = df.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in small_batches(batches, text):
            sizes, best, spans = [], [], []
            for words in words_of(batch.column(2)):
                found = segments(table[words].max(axis=1).astype(float)) if len(words) else []
                sizes.append(len(words))
                best.append(max((s for s, _, _ in found), default=0.0))
                spans.append([{"score": s, "first": a, "last": b} for s, a, b in found])
            kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
            new = [pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=[key, "label", "n_words", "best", "spans"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, label int, n_words long, best double, spans array<struct<score:double,first:long,last:long>>"
    return stored(df.select(key, "label", text).mapInArrow(run, schema))


def rising(values: list[float], sizes: list[float]) -> list[float]:
    """The rising sequence nearest to ``values``: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, n in zip(values, sizes):
        pools.append([v, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, k2 = pools.pop()
            v1, n1, k1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return [v for v, _, k in pools for _ in range(int(k))]


def evidence(location: float, scale: float, limit: float = 0.05):
    """The summed surprise of a text's significant segments as a column.

    A segment of score s in n words is as surprising as the chance that the best of n words' segments reaches s.
    """
    def surprise(s):
        x = (s["score"] - F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")) * scale - F.lit(location)) / scale
        chance = -F.expm1(-F.exp(-x))  # one minus the extreme-value law
        return F.when(x > 30, x).otherwise(-F.log(F.greatest(chance, F.lit(1e-13))))

    found = F.transform("spans", surprise)
    significant = F.filter(found, lambda v: v > -math.log(limit))
    return F.aggregate(significant, F.lit(0.0), lambda a, v: a + v)


def scored(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, score, evidence, n_words, spans) of every text. ``labels`` has ``key`` and ``label`` (0 or 1) to learn from."""
    known = labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("label").cast("int").alias("label"))
    known = stored(hash_sample(known, [key], sample, known.count()))
    marked = df.select(key, text).join(F.broadcast(known), key, "left")  # at most ``sample`` rows
    counts = counted(marked, text, "label").toArrow()  # at most SIZE rows
    scores = weights(*(np.asarray(counts.column(c), dtype=np.int64) for c in ("token", "harmless", "toxic", "everywhere")))
    seen = scanned(marked, scores, key, text)

    # The extreme-value law of harmless documents: moments of best - scale * log n, with the scale that they give.
    size = F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    moments = [F.avg("best"), F.avg(size), F.var_pop("best"), F.var_pop(size), F.covar_pop("best", size)]
    best, words, var_best, var_words, both = (x or 0.0 for x in seen.where("label = 0").agg(*moments).first())
    scale = 1.0
    for _ in range(ROUNDS):
        spread = var_best - 2 * scale * both + scale * scale * var_words
        scale = max(math.sqrt(max(spread, 0.0) * 6) / math.pi, 1e-3)
    location = best - scale * words - 0.5772 * scale
    judged = seen.withColumn("evidence", evidence(location, scale))

    # Rate of toxic labels by evidence, in bins of a fixed number.
    bin_ = F.when(F.col("evidence") <= 0, 0).otherwise(1 + F.least(F.floor(F.log2(F.col("evidence")) * 4).cast("int") + 4, F.lit(46)))
    bin_ = F.greatest(F.lit(0), bin_)
    rates = {r["bin"]: (r["toxic"], r["n"]) for r in judged.where("label is not null").groupBy(bin_.alias("bin")).agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()}
    bins = [rates.get(k, (0, 0)) for k in range(48)]
    total = sum(n for _, n in bins)
    base = sum(t for t, _ in bins) / total if total else 0.0
    filled = [k for k in range(48) if bins[k][1]]
    up = rising([(bins[k][0] + 0.1 * base) / (bins[k][1] + 0.1) for k in filled], [bins[k][1] for k in filled])
    curve = np.interp(np.arange(48), filled, up).tolist() if filled else [0.0] * 48
    rate = F.element_at(F.array(*[F.lit(float(c)) for c in curve]), bin_ + 1)
    # Within a bin, more evidence stays ahead by less than a thousandth.
    score = F.least(F.lit(1.0), rate * 0.999 + F.lit(0.001) * F.col("evidence") / (F.col("evidence") + 10))
    return judged.select(key, score.alias("score"), "evidence", "n_words", "spans")
