"""Periodic runs against every period of every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.llm import periodic_runs
from dyadspark.llm.queries import QUERIES
from tests.llm.fixtures import corpus, documents, empty

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """All maximal stretches per period; a period counts where no smaller one holds the whole stretch."""
    n, found = len(words), {}
    numbers = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // times + 1):
        same = np.concatenate([[0], numbers[q:] == numbers[:-q], [0]]).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if b - a + q >= max(least, times * q):
                found.setdefault((int(a), int(b - a + q)), q)  # periods rise, so the first one is the smallest
    smaller = [(a, length, q) for (a, length), q in found.items()]
    kept = [r for r in smaller if not any(o[2] < r[2] and o[0] <= r[0] and r[0] + r[1] <= o[0] + o[1] for o in smaller)]
    return sorted(kept, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    out = []
    for k in range(120):
        words = []
        while len(words) < rng.randint(0, 160):
            part = [rng.choice("abc" if k % 2 else "abcdefghijklmnop") for _ in range(rng.choice([1, 2, 3, 5, 9, 17]))]
            words += part * rng.choice([1, 1, 2, 3, 4, 9, 24])
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    fib = "a", "ab"
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    long = [rng.choice("xyz") for _ in range(700)]
    return [*out, " ".join(fib[1]), " ".join("ab" * 30 + "a" + "ab" * 30), " ".join(long * 4), " a" * 24, "a " * 23, " ".join(["a"] * 23 + ["b"])]


@pytest.mark.parametrize("least,times", [(24, 3), (1, 3), (10, 4)])
def test_runs_are_all_runs(spark, least, times):
    rows = list(enumerate(texts())) + [(1000 + k, t) for k, (_, t) in enumerate(corpus())]
    docs = documents(spark, rows).withColumn("runs", F.lit(7))
    got = periodic_runs.found(docs, least=least, times=times).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want = brute(words, least, times) if len(words) < 4000 or r["doc_id"] > 1000 else None
        assert r["n_words"] == len(words)
        assert [tuple(x) for x in r["_runs"]] == want, (words, least, times)
        assert r["collapsed"] == collapse(words, want)


def test_splitting_only_saves_work(spark, monkeypatch):
    rng = random.Random(5)
    numbers = np.array([rng.randrange(40) for _ in range(500)] + [k % 9 for k in range(60)] + [rng.randrange(400) for _ in range(500)])
    first = np.array([0, 300, 300, len(numbers)])
    want = [x.tolist() for x in periodic_runs.scan(numbers, first, 24, 3)]
    assert len(want[0]) == 1 and len(periodic_runs.segments(numbers, first, 24, 3)[0]) < 200
    monkeypatch.setattr(periodic_runs, "ROUNDS", 1)
    assert [x.tolist() for x in periodic_runs.scan(numbers, first, 24, 3)] == want


def test_odd_input(spark):
    assert periodic_runs.found(empty(spark)).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in periodic_runs.found(only).collect()] == [(0, [], ""), (0, [], "")]
    with pytest.raises(ValueError):
        periodic_runs.found(only, times=2)


def test_query_keeps_its_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs, r = brute(words), got[d["doc_id"]]
        planted += bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 10
