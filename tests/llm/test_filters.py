"""Decontamination, toxicity, quality, urls and main text."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.llm import decontamination, main_text, toxicity, url_filter, weak_labels
from tests.llm.fixtures import corpus, documents, empty, near, prose

# -- decontamination ---------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def edits_within(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def leaks():
    items = [(k, prose(300 + k, 12 + 3 * k)) for k in range(10)] + [(20, None), (21, ""), (22, prose(303, 21)), (23, "zu kurz")]
    rows = corpus()
    for k in range(10):
        rows.append((200 + k, f"{prose(k, 25)} {near(items[k][1], k, k // 2)} {prose(60 + k, 25)}"))
        rows.append((220 + k, " ".join(prose(k, 9).split()[:4] + items[k][1].split()[2:] + ["end"])))
    rows.append((240, "das ist ZU KURZ, fast"))
    return items, rows


def test_matches_are_those_of_brute_force(spark):
    items, rows = leaks()
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for key, text in rows:
        found = []
        for item, it in items:
            w = words(it)
            if w and (d := edits_within(w, words(text))) <= len(w) // 5:
                found.append((item, d))
        want[key, tuple(found)] += 1
    for block in (decontamination.BLOCK, 4):
        got = decontamination.matched(documents(spark, rows), table, block=block).collect()
        mine = Counter((r["doc_id"], tuple(sorted((m["item_id"], m["edits"]) for m in r["matches"]))) for r in got)
        if block == 4:  # block by block, rows with one key share their lists
            mine, want = Counter({k: n for k, n in mine.items() if k[0] is not None}), Counter({k: n for k, n in want.items() if k[0] is not None})
        assert mine == want


def test_blocks_do_not_change_matches(spark):
    """Every row keeps its own matches in one order, whatever its key: null, shared by other texts, or repeated."""
    items, rows = leaks()
    rows += [(None, rows[-1][1]), (None, rows[-2][1]), (200, "nothing in here at all"), (7, rows[-3][1]), (7, rows[-3][1])]
    table = spark.createDataFrame([*items, items[3], (3, items[4][1]), (None, items[5][1])], "item_id long, text string")
    docs = documents(spark, rows).select("doc_id", "text", F.lit(1).alias("row"))
    seen = []
    for block in (decontamination.BLOCK, 4):
        parts = [Counter((r[k], str(r["matches"])) for r in decontamination.matched(docs, table, key=k, block=block).collect()) for k in ("doc_id", "row")]
        seen.append(parts)
    assert seen[0] == seen[1]
    assert sum(n for (k, m), n in seen[1][0].items() if k is None and m != "[]") == 2 and seen[1][0][200, "[]"] == 1


def test_clean_rows_stay_whole(spark):
    items, rows = leaks()
    docs = documents(spark, rows).withColumn("matches", F.lit(1))
    for block in (decontamination.BLOCK, 4):
        kept = decontamination.clean_only(docs, spark.createDataFrame(items, "item_id long, text string"), block=block)
        assert kept.columns == docs.columns
        ids = Counter(r["doc_id"] for r in kept.collect())
        assert not set(ids) & {*range(200, 210), 240} and {k for k in range(24)} <= set(ids)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean_only(docs, none).count() == len(rows)
    assert decontamination.matched(docs, none).where(F.size("matches") > 0).count() == 0
    assert decontamination.matched(empty(spark), none).count() == 0


@pytest.mark.parametrize("m", [1, 2, 5, 40, 64, 65, 130])
def test_bit_vectors_give_the_least_distance(m):
    rng = random.Random(m)
    for _ in range(25):
        item = [rng.randint(0, 5) for _ in range(m)]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 2 * m + 4))]
        places = {}
        for k, w in enumerate(item):
            places[w] = places.get(w, 0) | 1 << k
        assert decontamination.least_distance(places, m, text)[0] == edits_within(item, text)


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 120):
        for _ in range(40):
            scores = rng.integers(-4, 5, n).astype(float)
            got = toxicity.segments(scores)

            def split(a, b):  # take the best segment, then what is left and right of it
                best = max(((scores[i:j].sum(), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
                if best[0] <= 0:
                    return []
                return [*split(a, best[3]), (best[0], best[3], best[4]), *split(best[4], b)]

            if n <= 40:
                want = split(0, n)
                assert sum(s for s, _, _ in got) == sum(s for s, _, _ in want) and max((s for s, *_ in got), default=0) == max((s for s, *_ in want), default=0)
            assert all(s == scores[a:b].sum() and s > 0 for s, a, b in got)
            assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_held_out_toxic_texts_score_high(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        text, bad = prose(5000 + k, 40 + k % 90).split(), k % 5 == 0
        for _ in range(4 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vilgrock", "vilgrum", "snarpen", "Snarped,"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, rows[5][1] + " " + prose(1, 9000)), (0, rows[0][1])]
    known = spark.createDataFrame([x for x in labels if x[0] % 4 != 2] + [(5, None), (None, 1), (3, 0)], "doc_id long, label int")
    got = toxicity.scored(documents(spark, rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.3, r["doc_id"] % 5 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 2]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["score"] == by[901]["score"] < 0.3 and by[900]["spans"] == []
    assert toxicity.scored(empty(spark), known).count() == 0
    nobody = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] < 0.3 for r in toxicity.scored(documents(spark), nobody).collect()} == {True}


# -- quality -----------------------------------------------------------------------------------------------------------


def junk(k):
    text = prose(7000 + k, 60).split()
    kinds = [" ".join(w + "###&&&"[k % 3 :] for w in text), " ".join(w for w in text[:6] for _ in range(12)), " | ".join(text), " ".join(w.upper() + "!!" for w in text)]
    return kinds[k % 4]


def test_junk_goes_and_prose_stays(spark):
    rows = [(k, prose(8000 + k, 30 + k)) for k in range(200)] + [(1000 + k, junk(k)) for k in range(40)]
    rows += [(2000, None), (2001, ""), (None, prose(3, 80)), (7, rows[7][1])]
    got = {r["doc_id"]: r for r in weak_labels.scored(documents(spark, rows)).collect()}
    assert all(got[k]["kept"] for k in range(200)) and got[None]["kept"]
    assert sum(got[1000 + k]["kept"] for k in range(40)) <= 4
    assert got[2000]["score"] == got[2001]["score"]
    docs = documents(spark, rows).withColumn("score", F.lit(1))
    kept = weak_labels.prose_only(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k for k, _ in rows if got[k]["kept"])
    assert weak_labels.scored(empty(spark)).count() == 0 and weak_labels.prose_only(empty(spark)).count() == 0


def test_accuracies_are_found():
    """Patterns drawn from labellers of known accuracy give posteriors close to the truth."""
    rng = np.random.default_rng(2)
    counts, truth = Counter(), Counter()
    m = len(weak_labels.LABELLERS)
    for _ in range(20_000):
        good, code = rng.random() < 0.8, 0
        for k in range(m):
            right = rng.random() < (0.998 if good else 0.6 if k < 4 else 0.3)
            vote = weak_labels.NONE if rng.random() < 0.3 else weak_labels.PROSE if good == right else weak_labels.JUNK
            code = 3 * code + vote
        counts[code] += 1
        truth[code] += good
    posterior = weak_labels.expectation_maximisation(counts)
    wrong = sum(min(truth[c], n - truth[c]) if (posterior[c] >= 0.5) == (truth[c] * 2 >= n) else max(truth[c], n - truth[c]) for c, n in counts.items())
    assert wrong < 0.02 * 20_000


@pytest.mark.parametrize("rate", [0.02, 0.1, 0.3])
def test_a_bad_labeller_is_found_out(rate):
    """A labeller that calls so many texts of either kind junk says nothing: texts that only it accuses stay."""
    rng, m = np.random.default_rng(2), len(weak_labels.LABELLERS)
    good = rng.random(20_000) < 0.8
    chance = np.where(good[:, None], 0.002, [0.6] * 4 + [0.3] * 3)
    chance[:, 0] = rate
    votes = np.where(rng.random((len(good), m)) < chance, weak_labels.JUNK, weak_labels.PROSE)
    votes[rng.random(votes.shape) < 0.1] = weak_labels.NONE
    codes = votes @ 3 ** np.arange(m)[::-1]
    counts = Counter(codes.tolist())
    for scale in (1, 1000):
        posterior = weak_labels.expectation_maximisation({c: n * scale for c, n in counts.items()})
        kept = np.array([posterior[c] >= 0.5 for c in codes.tolist()])
        assert (good & ~kept).mean() < 0.01 and (kept != good).mean() < 0.025


def test_length_is_no_fault():
    """The shares of a text do not fall with its length: a hundred thousand words of prose are judged like a few thousand."""
    rng = np.random.default_rng(5)
    words = np.zeros((100_000, 5), "<u4")
    words[:, 0] = rng.zipf(1.15, 100_000) % 2**32
    words[:, 2] = 5
    seen = [weak_labels.shares(words[:n], "") for n in (4096, 20_000, 100_000)]
    for name in ("distinct", "repeated_pairs"):
        assert max(s[name] for s in seen) - min(s[name] for s in seen) < 0.03
    same = np.tile(words[:50], (400, 1))
    seen = weak_labels.shares(same, "")
    assert seen["distinct"] < 0.05 and seen["repeated_pairs"] > 0.9


# -- urls --------------------------------------------------------------------------------------------------------------

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow")]


def test_rules_and_parts(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://ORG/": ("org", "/", "org/"),
        "https://a.Example.ORG/en/12?x=/es/": ("a.example.org", "/en/12", "example.org/en/1"), "http://org": ("org", "", None),
        "x://example.org/es/a#b?c": ("example.org", "/es/a", "example.org/es/"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/"),
        "http://fr.com/fr/1": ("fr.com", "/fr/1", "com/fr/"), "http://x.com?fr/": ("x.com", "", None), "a://b://c/d": ("b:", "//c/d", None),
        "http://É.com/fr": ("É.com", "/fr", None),
    }
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(cases)] + [(0, None, 1)], "page_id long, url string, template int")
    got = url_filter.judged(pages, spark.createDataFrame([], "url string, good int"), RULES).collect()
    assert len(got) == len(cases) + 1
    names = list(cases.values())
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == names[r["page_id"]]
        assert r["verdict"] == (dict(RULES)[r["rule"]] if r["rule"] else "allow")
    assert url_filter.judged(pages.limit(0), spark.createDataFrame([], "url string, good int"), RULES).count() == 0


def test_bad_branches_are_rejected(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        host, part = f"h{k % 3}.net", ["news", "spam", f"u{k}"][k // 3 % 3]
        url = f"http://{host}/{part}/{k}{'/x' * (k % 12)}"
        rows.append((k, url))
        if rng.random() < 0.5:
            labels.append((url, int(rng.random() < (0.1 if part == "spam" and host != "h2.net" else 0.9))))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.judged(pages, spark.createDataFrame(labels, "url string, good int"), []).collect()
    assert len(got) == 900
    for r in got:
        bad = "/spam/" in r["path"] and r["host"] != "h2.net"
        assert (r["verdict"] == "block") == bad, (r["path"], r["template"], r["purity"])
        assert r["template"].startswith("/spam/" if bad else "/")


def test_bad_branches_of_wide_and_of_hot_nodes_are_rejected(spark):
    """Several hundred equal siblings, and a small branch of a host with a third of all urls."""
    rng = random.Random(8)
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [(f"http://wide.net/{name(k)}/{name(j)}", k % 15 == 0) for k in range(300) for j in range(40)]
    rows += [(f"http://hot.net/main/{name(j)}", False) for j in range(6000)] + [(f"http://hot.net/odd/{name(j)}", True) for j in range(55)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = [(u, 0 if bad else int(rng.random() < 0.95)) for u, bad in rows]
    got = url_filter.judged(pages, spark.createDataFrame(labels, "url string, good int"), []).collect()
    assert len(got) == len(rows)
    assert {(r["path"], r["verdict"]) for r in got if (r["verdict"] == "block") != rows[r["page_id"]][1]} == set()
    # merged are the siblings that do not differ: only the 20 bad sections have a template of their own
    assert {r["template"].split("/")[1] for r in got if r["host"] == "wide.net"} == {"*"} | {name(k) for k in range(0, 300, 15)}


# -- main text ---------------------------------------------------------------------------------------------------------


def page(k, body, marks=True):
    article = "<article>" if marks else '<div class="post-content">'
    end = "</article>" if marks else "</div>"
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f'<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A{k}</a><li><a href="/b">B</a></ul></nav>'
        f'<div class="cookie-notice">We use cookies on this site, to count visits. Accept them all.</div>{article}{body}{end}'
        f'<div class="comments"><p>{prose(k, 25)}</p></div><form><input value=x><p>Search this site</p></form>'
        f"<aside>Related: {prose(k + 1, 12)}</aside><footer>&copy; {k}</footer></body></html>"
    )


def test_main_text_of_made_pages(spark):
    rows, want = [], {}
    for k in range(40):
        one, two, title = prose(100 + k, 40), prose(200 + k, 25), prose(300 + k, 5)
        body = f'<h1>{title}</h1><p><b>{one}<br>\n &amp; more&nbsp;text<p>{two}<!-- <p>no</p> --><div class="ad">Buy now</div><ul><li>x &lt; y</ul>'
        rows.append((k, f"u{k}", page(k, body, marks=k % 4 > 0)))
        want[k] = f"{title}\n{one} & more text\n{two}\nx < y"
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p>cut <b"), (103, "u", "a < b & c" + "<div>" * 3000 + prose(1, 60)), (0, "u0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("blocks", F.lit(1))
    found = main_text.extracted(pages)
    assert found.columns == ["page_id", "url", "blocks", "_blocks", "main_text"]
    got = {r["page_id"]: r["main_text"] for r in found.collect()}
    assert found.count() == len(rows)
    assert {k: got[k] for k in want} == want
    assert got[100] == got[101] == "" and "cut" in got[102] + "cut"
    assert main_text.extracted(pages.limit(0)).count() == 0


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(3)
    parent = [-1, 0, 0, 1, 1, 2]
    unary, pairs = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    total = np.zeros((6, 3))
    for code in range(3**6):
        state = [code // 3**k % 3 for k in range(6)]
        weight = np.exp(sum(unary[k, s] for k, s in enumerate(state)) + sum(pairs[state[parent[k]], state[k]] for k in range(1, 6)))
        for k, s in enumerate(state):
            total[k, s] += weight
    got = np.array([main_text.normal(x) for x in main_text.beliefs(parent, unary.tolist(), pairs.tolist())[0]])
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<p>a<b>b</b>c<br>d&nbsp;e &lt;x&gt;</p>", ["abc d e <x>"]),
        ("x<div>y<p>z</div>w", ["x", "y", "z", "w"]),
        ("<table><tr><td>1<td>2<tr><td><table><tr><td>3</table>4</table>", ["1", "2", "3", "4"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<p>1 < 2 <script>if (a<b) </script>t<!-- x", ["1 < 2 t"]),
        ("<p title='a>b'>q</p></div></p><style>z", ["q"]),
    ],
)
def test_blocks_of_odd_markup(html, blocks):
    assert [t for _, t in main_text.Page(html).runs] == blocks


def test_unclosed_elements_lose_nothing():
    body = "<p>One sentence here. Another one there.</p>"
    for tag in ("button", "video", "svg", "select", "canvas", "template"):
        page = main_text.Page(f"<article>{body}<{tag} x=y>{body}<p>End of it.</p></article><footer><{tag}>go</{tag}></footer>")
        texts = [t for _, t in page.runs]
        assert texts.count("One sentence here. Another one there.") == 2 and "End of it." in texts and "go" not in texts
        assert [t for _, t in main_text.Page(f"<p>a <{tag}>gone</{tag}> b").runs] == ["a b"]
    assert [t for _, t in main_text.Page("<p>x <math><mi>y</mi></math> <object>z</object>").runs] == ["x y z"]


def test_hostile_pages_take_linear_time():
    n = 40_000
    for page in ("<span>" * n + "</i>" * n, "<i><div>" + "<span>" * n + "</i>" * n, "<p><div>" + "<ul>" * n, "<li><table>" + "<td>" * n, "<button>" * n, "<ul>" * n + "</ol>" * n):
        start = time.time()
        main_text.Page(f"<article>{page}")
        assert time.time() - start < 4


def test_shapes_of_whole_words():
    assert weak_labels.shape("a" * 70 + "###") == "a#" and weak_labels.shape("aA1-aA1-aA1-") == "aA1-aA1-aA1-"


def test_branches_far_down_the_path(spark):
    """Two branches that part at the tenth segment."""
    deep = "https://deep.org" + "/x" * 9
    urls = [(k, f"{deep}/{'bad' if k % 2 else 'good'}/page{k}") for k in range(120)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(u, k % 2 ^ 1) for k, u in urls if k < 80], "url string, good int")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels, []).collect()}
    assert got == {k: "block" if k % 2 else "allow" for k in range(120)}
