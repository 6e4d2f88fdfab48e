"""Repeated passages, exact copies and near-duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dyadspark.llm import chosen_path, chunk_recipes, suffix_levels
from tests.llm.fixtures import corpus, documents, empty, near, prose


def covered(texts, window=200):
    """For each text its bytes and a flag per byte that a repeated string covers."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        flags = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                flags[i : i + window] = b"\1" * window
        out.append((b, flags))
    return out


def check_passages(spark, rows, **more):
    got = suffix_levels.without_repeats(documents(spark, rows), **more).collect()
    want = []
    for (key, _), (b, flags) in zip(rows, covered([t for _, t in rows])):
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(flags))]
        want.append((key, len(b), spans, bytes(x for x, f in zip(b, flags) if not f)))
    mine = [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)


def test_passages(spark):
    check_passages(spark, corpus())


def test_passages_of_many_lengths_in_other_batches(spark):
    shared = prose(1, 400)
    rows = [(k, f"{prose(10 + k, 20)}{shared[3 * k : 3 * k + 190 + k]}{prose(50 + k, 20)}") for k in range(30)]
    check_passages(spark, rows, batches=1)
    check_passages(spark, rows, batches=7)


def test_passages_window_by_window(spark, monkeypatch):
    """Heads with many bodies are counted over the cluster; the result is the same."""
    monkeypatch.setattr(suffix_levels, "GROUP", 3)
    shared = prose(2, 120)
    check_passages(spark, [(k, f"{prose(80 + k, 30)} {shared} {prose(130 + k, 30)}") for k in range(12)])


def test_passages_over_the_ends_of_pieces(monkeypatch):
    """A text longer than a piece gives the same windows, only in other runs."""
    text = prose(3, 3000).encode()
    whole = suffix_levels.anchored([text])
    monkeypatch.setattr(suffix_levels, "PIECE", 1000)
    parts = suffix_levels.anchored([text])
    runs = lambda found: {w: (b + a, h) for _, b, n, a, h, _ in zip(*(c.tolist() for c in found)) for w in range(b, b + n + 1)}
    assert runs(whole) == runs(parts)


def test_levels_grow_geometrically(spark):
    family = suffix_levels.indexed(documents(spark), batches=7)
    assert [size for size, _ in family.levels] == [4, 2, 1]
    for _, level in family.levels:
        assert level.count() == level.select("head").distinct().count()


def test_passages_of_no_texts(spark):
    assert suffix_levels.without_repeats(empty(spark)).collect() == []


# -- exact copies ------------------------------------------------------------------------------------------------------


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(spark):
    rows = corpus()
    groups = defaultdict(list)
    for key, text in rows:
        groups[plain(text)].append((-len(text or ""), key is None, key or 0, key))
    got = chunk_recipes.exact_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for key, text in rows:
        mine = groups[plain(text)]
        want[key, min(mine)[3], len(mine), hashlib.sha256(plain(text).encode()).hexdigest()] += 1
    assert Counter((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_copies_go(spark):
    docs = documents(spark).withColumn("row", F.lit(7)).withColumn("prints", F.lit("x"))
    kept = chunk_recipes.without_copies(docs)
    assert kept.columns == docs.columns
    texts = [plain(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({plain(t) for _, t in corpus()})
    assert chunk_recipes.without_copies(empty(spark)).count() == 0


def test_chunks_with_one_fingerprint(spark):
    """Recipes whose fingerprints agree but whose chunks differ are told apart."""
    rows = [(0, 10, 1, "a", [5], [b"x"]), (1, 11, 1, "b", [5], [b"y"]), (2, 12, 1, "a", [5], [b"x"]), (3, 13, 1, "c", [6], [b"z"])]
    made = spark.createDataFrame(rows, "row long, key long, n_code long, text_sha256 string, prints array<long>, digests array<binary>")
    got = {r["key"]: (r["keep_id"], r["group_size"]) for r in chunk_recipes.exact_groups(None, made=made).collect()}
    assert got == {10: (10, 2), 11: (11, 1), 12: (10, 2), 13: (13, 1)}


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(key, least.get(find(k), key))
    return Counter((key, least.get(find(k)), links[k]) for k, (key, _) in enumerate(rows))


def check_links(spark, rows):
    got = chosen_path.joined(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_links(rows)


def test_links(spark):
    check_links(spark, corpus())


def test_links_of_large_buckets(spark, monkeypatch):
    """Recursive splits, dense buckets and pairs of blocks give the same links, each counted once."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    base, passage = prose(5, 150), prose(6, 60)
    rows = [(k, near(base, k, k % 6)) for k in range(40)]
    rows += [(100 + k, f"{passage} {prose(200 + k, 60)}") for k in range(40)]
    check_links(spark, rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is close to 0.8 are found."""
    rows = []
    for k in range(60):
        text = prose(1000 + k, 200)
        rows += [(2 * k, text), (2 * k + 1, " ".join(text.split(" ")[:-20] + prose(3000 + k, 20).split(" ")))]
    want, got = brute_links(rows), chosen_path.joined(documents(spark, rows)).collect()
    found = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got)
    assert sum((found & want).values()) >= 0.98 * len(rows)
    assert sum(n for (_, _, n), c in want.items() for _ in range(c)) >= 100


def test_runs_follow_the_target_recall():
    """As many runs as the deepest buckets need, for every threshold; never fewer for a higher target."""
    assert chosen_path.runs_for(0.8) == 8 and chosen_path.runs_for(1.0) == 1
    for s in (0.3, 0.5, 0.7, 0.9):
        for recall in (0.9, 0.995, 0.9999):
            n, miss = chosen_path.runs_for(s, recall), 1 - s**chosen_path.LEVELS
            assert miss**n <= 1 - recall < miss ** (n - 1)
    for bad in ((0, 0.9), (1.1, 0.9), (0.8, 1.0)):
        with pytest.raises(ValueError):
            chosen_path.runs_for(*bad)


def test_recall_at_one_half_and_three_levels(spark, monkeypatch):
    """A lower threshold gets more runs, so that pairs in buckets split to the last level are found as well."""
    monkeypatch.setattr(chosen_path, "SMALL", 1)
    rows = []
    for k in range(60):
        text = prose(5000 + k, 120)
        rows += [(2 * k, text), (2 * k + 1, " ".join(text.split(" ")[:-38] + prose(6000 + k, 38).split(" ")))]
    sets = [shingle_set(t) for _, t in rows]
    want = {2 * k for k in range(60) if len(sets[2 * k] & sets[2 * k + 1]) * 2 >= len(sets[2 * k] | sets[2 * k + 1])}
    got = {r["doc_id"]: r["n_links"] for r in chosen_path.joined(documents(spark, rows), threshold=0.5).collect()}
    linked = {k for k in range(0, 120, 2) if got[k]}
    assert len(want) >= 40 and linked <= want and len(linked) >= 0.95 * len(want)


def test_one_of_each_class(spark):
    docs = documents(spark).withColumn("node", F.lit(1)).withColumn("class_id", F.lit(2))
    kept = chosen_path.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {k for k in range(24)} <= ids and not ids & {100, 101, 102, 103, 110, 111, *range(120, 126)}
    assert chosen_path.one_per_class(empty(spark)).count() == 0


def test_rows_of_one_key_are_decided_apart(spark):
    """Only the near copy goes, not another text of its key; of near copies without keys one stays."""
    base, other, third = prose(71, 80), prose(72, 80), prose(73, 80)
    rows = [(3, base), (5, near(base, 1, 1)), (5, other), (None, near(third, 1, 1)), (None, third), (None, prose(74, 60)), (None, ""), (9, third + " end")]
    kept = chosen_path.one_per_class(documents(spark, rows)).select("doc_id", "text").collect()
    got = [(r.doc_id, r.text) for r in kept]
    assert (3, base) in got and (5, other) in got and (5, near(base, 1, 1)) not in got
    assert (9, third + " end") in got and (None, prose(74, 60)) in got and (None, "") in got and len(got) == 5
    pair = [(None, near(third, 1, 1)), (None, third), (None, None)]
    kept = [r.text for r in chosen_path.one_per_class(documents(spark, pair)).collect()]
    assert len(kept) == 2 and None in kept
