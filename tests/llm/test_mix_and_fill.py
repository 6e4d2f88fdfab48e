"""Mixing by systematic sampling and fill-in-the-middle against their rules in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dyadspark.llm import fill_middle, mixing
from dyadspark.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import corpus, documents, empty
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("key", ["op12_mixing", "op13_fill_middle"])
def test_agrees_with_sql(spark, key):
    assert compare(spark, duck(SF), key, QUERIES[key], ORACLES[key], SF).startswith("ok")


# -- fill in the middle ------------------------------------------------------------------------------------------------


def plain_move(key, text, seed=42, share=50, spm=80):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= share:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    odd = ["a <P> b", "<S>", "x <M", "<", "<P", " \n ", "one", " one", "one ", "日本 語 é ", "a\x0bb\x0c", "a\xa0b c", "x" * 200_000 + " " + "é" * 100_000 + " z"]
    return corpus() + [(2000 + 20 * j + k, t) for j in range(8) for k, t in enumerate(odd)]


@pytest.mark.parametrize("share,spm", [(50, 80), (100, 50), (100, 100), (0, 80)])
def test_moved_and_back(spark, share, spm):
    docs = documents(spark, odd_rows()).withColumn("form", F.lit("x")).withColumn("draws", F.lit(1))
    there = fill_middle.moved(docs, moved_share=share, spm_share=spm)
    assert there.columns == [*docs.columns, "n_units", "_form", "prefix_chars", "middle_chars", "moved"]
    got = fill_middle.restored(there, form="_form").collect()
    assert len(got) == len(odd_rows())
    forms = set()
    for r in got:
        want = plain_move(r["doc_id"], r["text"] or "", share=share, spm=spm)
        assert (r["n_units"], r["_form"], r["prefix_chars"], r["middle_chars"], r["moved"]) == want
        assert r["restored"] == (r["text"] or "")
        forms.add(want[1])
    assert forms == {(50, 80): {"plain", "spm", "psm"}, (100, 50): {"plain", "spm", "psm"}, (100, 100): {"plain", "spm"}, (0, 80): {"plain"}}[share, spm]


def test_rotation_is_in_place(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fill_middle, "SWAP", 3)
    for _ in range(300):
        text = bytes(rng.randrange(256) for _ in range(rng.randint(0, 40)))
        a, m, b = sorted(rng.randint(0, len(text)) for _ in range(3))
        out = bytearray(text)
        fill_middle.rotate(out, a, m, b)
        assert bytes(out) == text[:a] + text[m:b] + text[a:m] + text[b:]


def test_other_marks(spark):
    docs = documents(spark)
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    back = fill_middle.restored(fill_middle.moved(docs, moved_share=100, marks=marks), marks=marks)
    assert back.where(~F.col("restored").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert back.where(F.col("moved").contains("<|middle|>")).count() > 30
    for bad in (("a", "a", "b"), ("aba", "x", "y"), ("ab", "bc", "y"), ("", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError):
            fill_middle.moved(docs, marks=bad)


def test_fill_of_nothing(spark):
    assert fill_middle.restored(fill_middle.moved(empty(spark))).count() == 0


# -- mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Sizes by source in order; what goes beyond a limit is shared again by weight."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    target, left, full = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set()
    while left > 1e-6 and len(full) < len(sizes):
        open_ = sum(weight[s] for s in sizes if s not in full)
        add = {s: left * weight[s] / open_ for s in sizes if s not in full}
        left = 0.0
        for s, more in add.items():
            target[s] += more
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def mixture_rows():
    rng = random.Random(8)
    rows = [(k, rng.choice(["b", "b", "b", "a", "é", None, "Z"]), rng.choice([0, 1, 5, 40, 300, rng.randint(1, 2000)])) for k in range(900)]
    rows += [(None, "b", 7), (None, "b", 7), (3, "b", None), (5, "", 12), (6, "none", 0), (7, "none", 0)]
    return rows + [(10_000 + k, "hot", 50) for k in range(500)]


def test_targets_and_copies(spark):
    rows = mixture_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit(1))
    got = mixing.sampled(df.repartition(7))
    assert got.columns == [*df.columns, "source_size", "_target", "copies"]
    got = got.collect()
    assert len(got) == len(rows)
    sizes = {}
    for s in sorted({r[1] for r in rows}, key=lambda s: (s is None, s or "")):
        sizes[s] = sum(r[2] or 0 for r in rows if r[1] == s)
    want = plain_targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["_target"] == pytest.approx(want[s])
        expected = want[s] / sizes[s] if sizes[s] else 0
        assert all(int(expected) <= r["copies"] <= min(2, int(expected) + 1) for r in mine)
        taken = sum((r["size"] or 0) * r["copies"] for r in mine)
        assert abs(taken - want[s]) <= max(r["size"] or 0 for r in mine)
        assert abs(sum(r["copies"] for r in mine) - expected * len(mine)) < 1 + 1e-9


def test_reruns_agree_and_rows_come_out(spark):
    df = spark.createDataFrame(mixture_rows(), "doc_id long, source string, size long")
    first, second = (sorted(map(str, mixing.sampled(df.repartition(n, "size")).collect())) for n in (3, 11))
    assert first == second
    some = mixing.sampled(df)
    rows = mixing.emitted(some)
    assert rows.columns == [*df.columns, "source_size", "target", "copy_no"]
    assert rows.count() == some.agg(F.sum("copies")).first()[0]


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.sampled(df).collect() == []
    none = spark.createDataFrame([(1, None, 0), (2, "a", None)], "doc_id long, source string, size long")
    assert sorted(r["copies"] for r in mixing.sampled(none).collect()) == [0, 0]
