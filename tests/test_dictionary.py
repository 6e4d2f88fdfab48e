"""Pattern dictionaries against trying every pattern on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dyadspark.functions.dictionary import Dictionary, all_matches, cores, first_match
from dyadspark.operators import codes as K

pytest.importorskip("ahocorasick")


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("ment", ["ment"]), ("widget|gadget", ["widget", "gadget"]), ("^small", ["small"]), ("ment|mente", ["ment"]), ("[0-9]+", None), ("a|[bc]", None),
        ("^(?!.*dem)(?!south).*\\bcongo\\b", ["congo"]), ("(?:uni)ted.?kingdom", ["kingdom"]), ("(ab)+c?", ["ab"]), ("x*", None), ("(?i)abc", None), ("", None),
    ],
)
def test_cores(pattern, want):
    assert cores(pattern) == want


def by_place(patterns, text):
    best = {}
    for p in patterns:
        if re.fullmatch("[a-z]+", p):
            spans = [(a, a + len(p)) for a in range(len(text)) if text.startswith(p, a)]
        else:
            spans = [m.span() for m in re.finditer(p, text) if m.end() > m.start()]
        for a, b in spans:
            best[a] = max(b, best.get(a, 0))
    return [text[a : best[a]] for a in sorted(best)]


PATTERNS = ["ment", "mente", "entend", "aa", "aaa", "b+c", "[cd]{2}", "^ab", "x?y", "a|dd|mentor"]


def texts():
    rng = random.Random(2)
    return ["", "mentend ment mente", "aaaaa", "abab bbc ccdd"] + ["".join(rng.choice("abcdxyment ") for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_all_and_first_by_trying_everything():
    known = Dictionary(PATTERNS)
    for t in texts():
        assert known.all(t) == by_place(PATTERNS, t)
        assert known.first(t) == next((i for i, p in enumerate(PATTERNS) if re.search(p, t)), None)
    assert Dictionary(["[0-9]"]).all("a1b22") == ["1", "2", "2"] and Dictionary([]).all("abc") == []


def test_only_met_patterns_are_tried():
    """A thousand patterns cost a text no more than those whose core it holds."""
    known = Dictionary([f"w{i}x.*y" for i in range(1000)])
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def search(self, text):
            tried.append(self.pattern.pattern)
            return self.pattern.search(text)

    known.compiled = [Counted(p) for p in known.compiled]
    assert known.first("nothing here") is None and not tried
    assert known.first("w7x and w500x and y") == 7 and tried == ["w7x.*y"]


def test_columns(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(-1, None)]
    df = spark.createDataFrame(rows, "id INT, t STRING").repartition(3)
    got = df.select("id", "t", all_matches(F.col("t"), PATTERNS).alias("m"), first_match(F.col("t"), PATTERNS, PATTERNS).alias("f")).collect()
    known = Dictionary(PATTERNS)
    for r in got:
        assert (r.m, r.f) == ((None, None) if r.t is None else (known.all(r.t), None if known.first(r.t) is None else PATTERNS[known.first(r.t)]))
    names = spark.createDataFrame([("Big WIDGET",), ("red widget",), (None,), ("plain",)], "n STRING")
    coded = {r.n: r.c for r in K.recode_name(names, "n", [("gadget|widget", "W"), ("big", "B")], "c", {"red widget": "R"}).collect()}
    assert coded == {"Big WIDGET": "W", "red widget": "R", None: None, "plain": None}
