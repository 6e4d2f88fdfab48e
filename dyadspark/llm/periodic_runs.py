"""Stretches of words that repeat with a period, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``times`` * q and at
least ``least`` words long, which neither neighbour extends with the same period.

Splitting: every word of a run stands in it ``times`` times or more, so a word that is rarer than that within its
segment belongs to no run and splits the segment. Pieces shorter than ``least`` go; the others are counted again, until
no segment has a rare word. Ordinary prose falls apart within a few rounds.

Lag scan: in what survives, each place looks for the next place with the same k words, k = 8, 16, 32, ... (for
``least`` = 24). A run of period q > k/2, q <= k, has the lag q at its first place and at every other one up to q + k words
before its end, and no shorter one, because k words that recur earlier would give the run a smaller period. So the runs
are exactly the stretches of equal lags, and a text of n words needs O(n log^2 n) steps whatever its periods are. Equal
stretches of 2k words are equal pairs of stretches of k words, and places whose k words do not recur are left out of
longer ones.

A null text has no words; texts never share runs and are taken whole, whatever their length; rows may repeat; other
columns are kept, and new ones whose name is taken get leading underscores. Empty tables give empty results. A task
holds one small batch of texts (or one longer text) at a time, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm.common import BLANK, free_name, small_batches, text_bytes, word_bounds

ROUNDS = 64  # of splitting; the scan is exact on any segments, so later rounds could only save time
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per word (equal words, equal numbers), the words' bytes without what lies between, and their offsets."""
    solid = data[~BLANK[data]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), solid, offsets


def segments(numbers: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive the splitting, ascending, and the number of the segment of each (ascending as well)."""
    kinds = int(numbers.max()) + 1 if len(numbers) else 1
    place, segment = np.arange(len(numbers)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    done_place, done_segment, used, rounds = [], [], 0, 0
    while len(place):
        new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(segment) != 0)])
        segment = np.cumsum(new) - 1
        long_enough = (np.bincount(segment) >= least)[segment]
        place, segment = place[long_enough], segment[long_enough]
        if not len(place):
            break
        _, kind, counts = np.unique(segment * kinds + numbers[place], return_inverse=True, return_counts=True)
        common = (counts >= times)[kind]
        split = np.zeros(segment[-1] + 1, bool)
        if (rounds := rounds + 1) < ROUNDS:
            split[segment[~common]] = True
        stable = ~split[segment]
        done_place.append(place[stable])
        done_segment.append(segment[stable] + used)
        used += int(segment[-1]) + 1
        common &= ~stable
        place, segment = place[common], segment[common]
    if not done_place:
        return place, segment
    place, segment = np.concatenate(done_place), np.concatenate(done_segment)
    order = np.argsort(place)
    place, segment = place[order], segment[order]
    return place, np.cumsum(np.concatenate([[0], np.diff(segment) != 0])) if len(place) else segment


def stretches(rank: np.ndarray, alive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and lag of all stretches of places whose next equal place is the same lag away."""
    order = alive[np.argsort(rank[alive], kind="stable")]
    lag = np.diff(order)
    found = (np.diff(rank[order]) == 0) & (lag > low) & (lag <= high)
    at, lag = order[:-1][found], lag[found]
    order = np.argsort(at)
    at, lag = at[order], lag[order]
    border = (np.diff(at) != 1) | (np.diff(lag) != 0)
    opens, closes = np.concatenate([[True], border])[: len(at)], np.concatenate([border, [True]])[: len(at)]
    return at[opens], at[closes], lag[opens]


def scan(numbers: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start, then period; starts count over all texts of the batch."""
    place, segment = segments(numbers, first, least, times)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    sizes = np.bincount(segment)
    end = np.repeat(np.cumsum(sizes), sizes)
    longest = int(sizes.max()) // times  # no period is longer
    _, rank = np.unique(segment * (int(numbers.max()) + 1) + numbers[place], return_inverse=True)
    alive, k, base, out = np.arange(len(place)), 1, 1, []
    while 4 * base <= least:
        base *= 2
    while len(alive):
        if k >= base:
            a, b, q = stretches(rank, alive, 0 if k == base else k // 2, k)
            length = b - a + q + k
            kept = length >= np.maximum(least, times * q)
            out.append((place[a[kept]], length[kept], q[kept]))
            if k >= longest:
                break
        again = (np.bincount(rank[alive]) > 1)[rank[alive]]
        alive = alive[again]
        alive = alive[alive + 2 * k <= end[alive]]
        held, rank = rank, np.full(len(place), -1)
        alive = alive[held[alive + k] >= 0]
        _, rank[alive] = np.unique(held[alive] * len(place) + held[alive + k], return_inverse=True)
        k *= 2
    start, length, period = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed_texts(solid: np.ndarray, offsets: np.ndarray, first: np.ndarray, dropped: np.ndarray) -> pa.Array:
    """The words that are not dropped, joined by one blank, text by text."""
    n, sizes = len(dropped), np.diff(offsets)
    kept = ~dropped
    before = np.concatenate([[0], np.cumsum(kept)])
    leads = np.zeros(n, bool)  # the first word that a text keeps has no blank before it
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    leads[kept] = before[:-1][kept] == before[first[:-1]][owner[kept]]
    spaced = np.full(len(solid) + n, 32, np.uint8)
    blank = offsets[:-1] + np.arange(n)
    body = np.ones(len(spaced), bool)
    body[blank] = False
    spaced[body] = solid
    wanted = np.repeat(kept, sizes + 1)
    wanted[blank] = kept & ~leads
    taken = np.concatenate([[0], np.cumsum(np.where(kept, sizes + ~leads, 0))])[first]
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(taken.astype(np.int32)), pa.py_buffer(spaced[wanted]))


def found(df: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """All columns of ``df`` and ``n_words`` long, ``runs`` array of (start, length, period), ``collapsed`` string.

    ``runs`` go by start, then period; starts are word numbers from 0. In ``collapsed`` a word is left out if a run
    holds it behind the run's first period; the others are joined by one blank. ``times`` must be 3 or more.
    """
    if times < 3 or least < 1:
        raise ValueError("runs need three periods or more and at least one word")
    names = [free_name(df, c) for c in ("n_words", "runs", "collapsed")]
    schema = T.StructType([*df.schema.fields, *map(T.StructField, names, (T.LongType(), T.ArrayType(RUN), T.StringType()))])
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            data, bounds = text_bytes(batch.column(column))
            starts, ends, first = word_bounds(data, bounds)
            numbers, solid, offsets = word_numbers(data, starts, ends)
            start, length, period = scan(numbers, first, least, times)
            cover = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.subtract.at(cover, start + length, 1)
            texts = collapsed_texts(solid, offsets, first, np.cumsum(cover[:-1]) > 0)
            owner = np.searchsorted(first, start, side="right") - 1
            fields = [pa.array(x.astype(np.int64)) for x in (start - first[owner], length, period)]
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(start, first).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
            )
            new = [pa.array(np.diff(first)), runs, texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def strongest(runs: str) -> Column:
    """The run with the greatest exact length / period of an array (ties: least start, then least period), or null."""
    return F.get(
        F.expr(f"""array_sort({runs}, (l, r) -> CASE
            WHEN l.length * r.period > r.length * l.period THEN -1 WHEN l.length * r.period < r.length * l.period THEN 1
            WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1
            WHEN l.period < r.period THEN -1 WHEN l.period > r.period THEN 1 ELSE 0 END)"""),
        F.lit(0),
    )
