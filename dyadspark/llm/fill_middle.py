"""Fill-in-the-middle texts by block rotation in place, and back.

A text's units are its words with the white space before them (white space at the end is a unit of its own). Two cuts
between units make prefix, middle and suffix. Cuts and form are drawn from a digest of seed and key, so reruns and other
partitionings agree: a share of the rows stays plain, the others become

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

The marks are put into a bytearray as ``<P>`` prefix ``<M>`` middle ``<S>`` suffix; then two neighbouring segments are
exchanged by three reversals, without a second copy of the text. ``restored`` finds the marks, exchanges the segments
back and takes the marks out again.

Null texts count as empty; empty texts and texts that hold a mark stay plain, so every text can be restored exactly. A
null key draws like an empty one; repeated rows are treated alike. Texts are taken whole, whatever their length. Other
columns are kept, and new ones whose name is taken get leading underscores. Empty tables give empty results. Rows are
handled one by one where they are, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm.common import BLANK, free_name, small_batches, text_bytes, word_bounds

MARKS = ("<P>", "<S>", "<M>")
SWAP = 1 << 16  # bytes exchanged at a time


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse the bytes ``a`` to ``b`` in place, from both ends, with one small block held aside."""
    while b - a > 1:
        n = min(SWAP, (b - a) // 2)
        held = view[a : a + n].copy()
        view[a : a + n] = view[b - n : b][::-1]
        view[b - n : b] = held[::-1]
        a, b = a + n, b - n


def rotate(text: bytearray, a: int, m: int, b: int) -> None:
    """Exchange the neighbouring segments ``a`` to ``m`` and ``m`` to ``b`` by three reversals."""
    view = np.frombuffer(text, np.uint8)
    reverse(view, a, m)
    reverse(view, m, b)
    reverse(view, a, b)


def move(text: bytes, cut1: int, cut2: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text in ``form``, cut before the bytes ``cut1`` and ``cut2``."""
    p, s, m = marks
    out = bytearray(text)
    out[cut2:cut2] = s
    out[cut1:cut1] = m
    out[0:0] = p
    middle = len(p) + cut1
    suffix = middle + len(m) + cut2 - cut1
    rotate(out, middle if form == "psm" else 0, suffix, len(out))
    return out


def restore(moved: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text that ``move`` was given."""
    p, s, m = marks
    out = bytearray(moved)
    if form == "plain":
        return out
    if form == "psm":
        rotate(out, out.index(s), out.index(m), len(out))
    else:
        rotate(out, 0, out.index(p), len(out))
    for mark in (s, m, p):  # from the back, so that the earlier ones keep their places
        at = out.index(mark)
        del out[at : at + len(mark)]
    return out


def _coded(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The marks as bytes; none may hold or overlap another one, so that none can arise at a border."""
    found = tuple(m.encode() for m in marks)
    for i, one in enumerate(found):
        for j, other in enumerate(found):
            if not one or (i != j and other in one) or any(other.startswith(one[k:]) for k in range(1, len(one))):
                raise ValueError(f"marks must be different and must not overlap: {marks}")
    return found


def characters(data: np.ndarray) -> int:
    """Code points of a stretch of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def moved(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, moved_share: int = 50, spm_share: int = 80,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """All columns of ``df`` and ``n_units`` long, ``form`` string, ``prefix_chars``, ``middle_chars`` long, ``moved`` string.

    ``moved_share`` of 100 rows are moved, ``spm_share`` of 100 of these to spm; the numbers of code points are null in
    plain rows.
    """
    coded = _coded(marks)
    kinds = {"n_units": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "moved": T.StringType()}
    names = [free_name(df, c) for c in kinds]
    schema = T.StructType([*df.schema.fields, *map(T.StructField, names, kinds.values())])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = free_name(df, "draws")
    column, width = df.columns.index(text), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            data, bounds = text_bytes(batch.column(column))
            _, ends, first = word_bounds(data, bounds)
            rows = []
            for row, drawn in enumerate(batch.column(width).to_pylist()):
                lo, hi = int(bounds[row]), int(bounds[row + 1])
                near, far = int(first[row]), int(first[row + 1])
                whole = data[lo:hi].tobytes()
                n = far - near + (hi > lo and bool(BLANK[data[hi - 1]]))
                h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in range(0, 32, 8))
                if not whole or h3 % 100 >= moved_share or any(m in whole for m in coded):
                    rows.append((n, "plain", None, None, whole.decode()))
                    continue
                after = [0 if not k else int(ends[near + k - 1]) - lo if k <= far - near else hi - lo for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
                form = "spm" if h4 % 100 < spm_share else "psm"
                sizes = characters(data[lo : lo + after[0]]), characters(data[lo + after[0] : lo + after[1]])
                rows.append((n, form, *sizes, move(whole, *after, form, coded).decode()))
            new = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*batch.schema.names[:width], *names])

    return df.withColumn(draws, F.substring(digest, 1, 32)).mapInArrow(run, schema)


def restored(df: DataFrame, output: str = "moved", form: str = "form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All columns of ``df`` and ``restored`` string: the text from which ``output`` was made."""
    coded, name = _coded(marks), free_name(df, "restored")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    columns = df.columns.index(output), df.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, output):
            texts, forms = (batch.column(c).to_pylist() for c in columns)
            back = [restore((t or "").encode(), f or "plain", coded).decode() for t, f in zip(texts, forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
