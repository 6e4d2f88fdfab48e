"""Tables, links and texts of web pages, one Arrow batch of pages at a time.

Elements are picked by selectors: names, ``#id``, ``.class``, ``[attribute]``, ``[attribute=value]`` (also ``~=``, ``^=``,
``$=``, ``*=``) and ``:nth-child(3 | 2n+1 | odd | even)``, ``:first-child``, in any number per element; elements are
joined by blanks (any depth) or ``>`` (direct child), several selectors by commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())  # never closed
PAGES = 200  # pages whose rows are held at a time
# fixed values of HTML: open elements that a start tag closes
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MOST_COLUMNS = 1000  # a cell spans no more columns, as HTML has it


# -- selectors ---------------------------------------------------------------------------------------------------------


@dataclass
class Step:
    """What one element of a selector must be, and whether it must be a direct child of the one before."""

    child: bool
    tag: str | None
    tests: list[tuple[str, str, str]]  # attribute, comparison, value
    places: list[tuple[int, int]]  # nth-child: a, b of a * n + b

    def fits(self, tag: str, attributes: dict[str, str], place: int) -> bool:
        if self.tag is not None and tag != self.tag:
            return False
        for name, how, want in self.tests:
            have = attributes.get(name)
            if have is None or not (
                how == ""
                or (how == "=" and have == want)
                or (how == "~=" and want in have.split())
                or (want and how == "^=" and have.startswith(want))
                or (want and how == "$=" and have.endswith(want))
                or (want and how == "*=" and want in have)
            ):
                return False
        return all((place == b) if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0 for a, b in self.places)


TOKEN = re.compile(
    r"""\s*(?P<join>[>,])\s*|(?P<blank>\s+)|(?P<tag>\*|[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~^$*]?=)\s*(?P<quote>["']?)(?P<value>.*?)(?P=quote)\s*)?\]
    |:nth-child\(\s*(?P<nth>[^)]*?)\s*\)|:(?P<first>first)-child""",
    re.VERBOSE,
)


def _nth(text: str) -> tuple[int, int]:
    text = {"odd": "2n+1", "even": "2n"}.get(text.lower(), text.lower()).replace(" ", "")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise ValueError(f"nth-child({text})")
    if m[3] is not None:
        return 0, int(m[3])
    return int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1]), int(m[2] or 0)


def selector(text: str) -> list[list[Step]]:
    """The alternatives of a selector, each a list of steps from the outermost element to the one that is picked."""
    out: list[list[Step]] = [[]]
    at, now, child, text = 0, None, False, text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not understood from {text[at:]!r}")
        at = m.end()
        if m["join"] or m["blank"]:
            if m["join"] and now is None:
                raise ValueError(f"selector {text!r}: an element is missing")
            now, child = None, m["join"] == ">"
            if m["join"] == ",":
                out.append([])
            continue
        if now is None:
            now = Step(child, None, [], [])
            out[-1].append(now)
            child = False
        if m["tag"]:
            now.tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            now.tests.append(("id", "=", m["id"]))
        elif m["cls"]:
            now.tests.append(("class", "~=", m["cls"]))
        elif m["name"]:
            now.tests.append((m["name"].lower(), m["how"] or "", m["value"] or ""))
        else:
            now.places.append((0, 1) if m["first"] else _nth(m["nth"]))
    if now is None or not all(out):
        raise ValueError(f"selector {text!r}: an element is missing")
    return out


class _Picked(HTMLParser):
    """Attributes and text of the elements that a selector picks.

    Every open element knows which steps end at it and which end at it or around it, so a start tag is judged from its
    parent alone, however deep it lies. Open elements are counted by name, so an end tag without a start costs nothing.
    """

    def __init__(self, alternatives: list[list[Step]]):
        super().__init__(convert_charrefs=True)
        self.alternatives = alternatives
        none = [0] * len(alternatives)
        self.open: list[list] = [["", none, none, 0, None]]  # name, steps at it, steps at or around it, children, its entry
        self.names: dict[str, int] = {}
        self.found: list[tuple[dict[str, str], list[str]]] = []
        self.texts: list[list[str]] = []  # of the picked elements that are open

    def handle_starttag(self, tag, attrs):
        for _ in range(2):  # a row closes a cell and then a row
            closes = CLOSES.get(tag, ())
            if self.open[-1][0] in closes:
                self._pop()
        if tag in ("br", "p", "div", "li", "tr", "td"):
            for text in self.texts:
                text.append(" ")
        parent = self.open[-1]
        parent[3] += 1
        attributes = {k: v or "" for k, v in attrs}
        here, around, hit = [], [], False
        for steps, ends, above in zip(self.alternatives, parent[1], parent[2]):
            bits = 0
            for i, step in enumerate(steps):
                before = i == 0 and not step.child or i > 0 and (ends if step.child else above) >> (i - 1) & 1
                if before and step.fits(tag, attributes, parent[3]):
                    bits |= 1 << i
            here.append(bits)
            around.append(bits | above)
            hit = hit or bool(bits >> (len(steps) - 1) & 1)
        entry = None
        if hit:
            entry = []
            self.found.append((attributes, entry))
        if tag not in VOID:
            self.open.append([tag, here, around, 0, entry])
            self.names[tag] = self.names.get(tag, 0) + 1
            if entry is not None:
                self.texts.append(entry)

    def _pop(self) -> str:
        tag, *_, entry = self.open.pop()
        self.names[tag] -= 1
        if entry is not None:
            self.texts.pop()
        return tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if self.names.get(tag, 0):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        for text in self.texts:
            text.append(data)


def _picked(html: str, alternatives: list[list[Step]]) -> list[tuple[dict[str, str], str]]:
    parser = _Picked(alternatives)
    parser.feed(html)
    parser.close()
    return [(attributes, "".join(text)) for attributes, text in parser.found]


# -- tables ------------------------------------------------------------------------------------------------------------


class _Tables(HTMLParser):
    """Cells by table and row, with the rows and columns they span; a cell ends where the next one begins.

    Every open table keeps its own current row and cell, so an outer cell goes on behind an inner table.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list[list]]] = []
        self.open: list[list] = []  # number of the table, its current row, whether a cell is open
        self.count = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([self.count, None, False])
            self.count += 1
        elif tag == "tr" and self.open:
            self._new_row(self.open[-1])
        elif tag in ("td", "th") and self.open:
            now = self.open[-1]
            if now[1] is None:
                self._new_row(now)
            spans = dict(attrs)
            now[1].append(["", _span(spans.get("rowspan"), 0), min(_span(spans.get("colspan"), 1) or 1, MOST_COLUMNS)])
            now[2] = True
        elif self.open and self.open[-1][2] and tag in ("br", "p", "div", "li"):
            self.open[-1][1][-1][0] += " "

    def _new_row(self, now: list) -> None:
        now[1], now[2] = [], False
        self.rows.append((now[0], now[1]))

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "th"):
            self.open[-1][2] = False
        elif tag == "tr":
            self.open[-1][1:] = None, False

    def handle_data(self, data):
        if self.open and self.open[-1][2]:
            self.open[-1][1][-1][0] += data


def _span(text: str | None, least: int) -> int:
    """A span's number; 1 where it is absent or none, 0 (where allowed) means to the end of the table."""
    m = re.match(r"\s*\+?(\d{1,9})", text or "")
    return max(int(m[1]), least) if m else 1


def _grid(rows: list[list[list]]) -> list[list[str | None]]:
    """Each cell's text in every place it covers: later rows keep the places that spanning cells of earlier ones hold."""
    held: dict[int, list] = {}  # column: text, rows left (-1: all)
    out = []
    for cells in rows:
        line: dict[int, str] = {}
        for column, (text, left) in list(held.items()):
            line[column] = text
            if left > 0:
                held[column][1] -= 1
            if held[column][1] == 0:
                del held[column]
        at = 0
        for text, down, wide in cells:
            while at in line:
                at += 1
            for column in range(at, at + wide):
                if column in line:
                    break  # the place is taken from above
                line[column] = text
                if down != 1:
                    held[column] = [text, down - 1]
            at += wide
        out.append(line)
    width = max((max(line, default=-1) + 1 for line in out), default=0)
    return [[line.get(c) for c in range(width)] for line in out]


def _cells(html: str, fill: bool = True) -> list[tuple[int, int, list[str | None]]]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    tables: dict[int, list[list[list]]] = {}
    order = []
    for table, cells in parser.rows:
        rows = tables.setdefault(table, [])
        order.append((table, len(rows)))
        rows.append([[" ".join(text.split()), down, wide] for text, down, wide in cells])
    grids = {n: _grid(rows) if fill else [[c[0] for c in row] for row in rows] for n, rows in tables.items()}
    return [(table, row, grids[table][row]) for table, row in order]


def _anchors(html: str, within: str | None = None, select: str | None = None) -> list[list[str]]:
    text = select or (f'[class~="{within}"] a, a[class~="{within}"]' if within else "a")
    return [[attributes["href"], words] for attributes, words in _picked(html, selector(text)) if "href" in attributes]


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same pages, ``PAGES`` at a time."""
    for pdf in batches:
        for k in range(0, len(pdf), PAGES):
            yield pdf.iloc[k : k + PAGES]


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html", fill: bool = True) -> DataFrame:
    """(key, table_no, row_no, cells) for every table row of every page.

    With ``fill`` a cell that spans rows or columns stands in every place it covers, and all rows of a table have the
    same length: places without a cell are NULL. Without it the cells come as they are written.
    """

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches):
            rows = [(k, *r) for k, h in zip(pdf[key], pdf[html]) if h for r in _cells(h, fill)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "cells"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(job, f"{key} {kind}, table_no INT, row_no INT, cells ARRAY<STRING>")


def html_links(
    pages: DataFrame, key: str = "page_id", html: str = "html", base: str | None = "url", within: str | None = None, select: str | None = None
) -> DataFrame:
    """(key, link_no, href, url, text) for every anchor; relative addresses are resolved against ``base``.

    ``within`` takes only anchors in elements of a class, ``select`` those elements with an address that a selector picks.
    """
    selector(select or "a")  # a bad one fails here, not in the tasks

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches):
            bases = pdf[base] if base else [""] * len(pdf)
            rows = [
                (k, i, href, urljoin(b or "", href), " ".join(text.split()))
                for k, b, h in zip(pdf[key], bases, pdf[html])
                if h
                for i, (href, text) in enumerate(_anchors(h, within, select))
            ]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "link_no", "href", "url", "text"])

    kind = dict(pages.dtypes)[key]
    needed = [key, html, *([base] if base else [])]
    return pages.select(*needed).mapInPandas(job, f"{key} {kind}, link_no INT, href STRING, url STRING, text STRING")


def html_texts(pages: DataFrame, select: str, key: str = "page_id", html: str = "html", attribute: str | None = None) -> DataFrame:
    """(key, item_no, text) for every element that a selector picks; with ``attribute`` also that attribute (or NULL) as ``value``."""
    alternatives = selector(select)

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches):
            rows = [
                (k, i, " ".join(text.split()), attributes.get(attribute or ""))
                for k, h in zip(pdf[key], pdf[html])
                if h
                for i, (attributes, text) in enumerate(_picked(h, alternatives))
            ]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "item_no", "text", "value"])[[key, "item_no", "text", *(["value"] if attribute else [])]]

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(job, f"{key} {kind}, item_no INT, text STRING" + (", value STRING" if attribute else ""))
