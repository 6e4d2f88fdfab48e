"""Selectors, spans and filled tables of web pages."""

import random
import time

import pytest

from dyadspark.functions.html import _anchors, _cells, _picked, html_links, html_tables, html_texts, selector

PAGE = """<body><div id="main" class="a b"><p class=x>one<p class="x y">two <b>deep</b><p>three</div>
<ul class=menu><li><a href=/1 rel="up next">first</a><li><a href="/2" title="Second one">second</a><li class=x><a name=q>third</a></ul>
<div class=a><div><p class=x>four</p></div><span data-k="v1">s</span></div></body>"""


@pytest.mark.parametrize(
    "text,want",
    [
        ("p", ["one", "two deep", "three", "four"]), (".x", ["one", "two deep", "third", "four"]), ("p.x", ["one", "two deep", "four"]), (".x.y", ["two deep"]),
        ("#main p", ["one", "two deep", "three"]), ("div > p", ["one", "two deep", "three", "four"]), (".a > p", ["one", "two deep", "three"]), (".a p.x", ["one", "two deep", "four"]),
        ("div div p", ["four"]), ("li:nth-child(2)", ["second"]), ("li:nth-child(odd) a", ["first", "third"]), ("p:nth-child(2n)", ["two deep"]), ("p:nth-child(-n+2)", ["one", "two deep", "four"]),
        ("p:first-child", ["one", "four"]), ("a[href]", ["first", "second"]), ("a[href='/2']", ["second"]), ("a[rel~=next]", ["first"]), ('a[title^="Sec"]', ["second"]),
        ("[data-k$='1']", ["s"]), ("[title*=one]", ["second"]), ("b, span", ["deep", "s"]), ("ul > a", []), ("*.menu li.x", ["third"]), ("body>ul>li:nth-child(3)>a", ["third"]),
    ],
)
def test_selectors(text, want):
    assert [" ".join(t.split()) for _, t in _picked(PAGE, selector(text))] == want


@pytest.mark.parametrize("text", ["", "a >", "> a >", "a,", "a:hover", "a[", "p:nth-child(x)", ", a"])
def test_bad_selectors(text):
    with pytest.raises(ValueError):
        selector(text)


def test_descendants_need_no_backtracking():
    """A step may be met by any open element, not only by the nearest one."""
    page = "<div class=a><section><div class=b><section><p>yes</p></section></div></section></div><div class=b><section><p>no"
    assert [t for _, t in _picked(page, selector(".a > section p"))] == ["yes"]
    assert [t for _, t in _picked(page, selector(".a .b > section > p"))] == ["yes"]


def test_hostile_pages_take_linear_time():
    for page in ("<span>" * 60_000 + "</i>" * 60_000, "<p>" * 60_000, "<li><ul>" * 30_000 + "</ol>" * 30_000):
        start = time.time()
        assert _picked(page, selector("div > b c, i:nth-child(3)")) == []
        assert time.time() - start < 5


def test_links(spark):
    assert [h for h, _ in _anchors(PAGE)] == ["/1", "/2"]
    assert [h for h, _ in _anchors(PAGE, select="li:nth-child(2) > a")] == ["/2"]
    pages = spark.createDataFrame([(1, "http://h/x/", PAGE), (2, None, None), (3, "http://h/", "")], "page_id INT, url STRING, html STRING")
    assert [tuple(r) for r in html_links(pages, select=".menu [rel]").collect()] == [(1, 0, "/1", "http://h/1", "first")]
    got = [tuple(r) for r in html_texts(pages, "li, span", attribute="data-k").orderBy("item_no").collect()]
    assert got == [(1, 0, "first", None), (1, 1, "second", None), (1, 2, "third", None), (1, 3, "s", "v1")]
    assert html_texts(pages, "p").columns == ["page_id", "item_no", "text"]


def test_spans_and_filling(spark):
    page = """<table><tr><td rowspan=2>A<td colspan=2>B<td>C<tr><td>d<td rowspan="2">e<tr><td>f<td colspan=0>g</table>
    <table><tr><td>1<table><tr><td rowspan=0>in<td>x<tr><td>y<tr></table>2<td rowspan=junk>3<tr></table>"""
    want = [
        (0, 0, ["A", "B", "B", "C"]), (0, 1, ["A", "d", "e", None]), (0, 2, ["f", "g", "e", None]),
        (1, 0, ["1 2", "3"]), (2, 0, ["in", "x"]), (2, 1, ["in", "y"]), (2, 2, ["in", None]), (1, 1, [None, None]),
    ]
    got = [(t, r, c) for t, r, c in _cells(page.replace("</table>2", "</table> 2"))]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert _cells("<table><tr><td rowspan=3>a<tr><td>b", fill=False) == [(0, 0, ["a"]), (0, 1, ["b"])]
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id INT, html STRING")
    assert html_tables(pages).count() == len(want)


def test_places_of_random_spans():
    """Every place belongs to the first cell that covers it, as in drawing cell by cell."""
    rng = random.Random(4)
    for _ in range(200):
        rows = [[(f"{r}.{c}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])) for c in range(rng.randint(0, 4))] for r in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d} colspan={w}>{t}" for t, d, w in row) for row in rows) + "</table>"
        drawn: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            at = 0
            for t, d, w in row:
                while (r, at) in drawn:
                    at += 1
                for c in range(at, at + w):
                    if (r, c) in drawn:
                        break
                    for down in range(r, min(r + d, len(rows))):
                        drawn.setdefault((down, c), t)
                at += w
        width = max((c + 1 for _, c in drawn), default=0)
        assert [c for _, _, c in _cells(page)] == [[drawn.get((r, c)) for c in range(width)] for r in range(len(rows))]
