"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element has one of three states: content, wrapper (holds content and other things), other. Potentials of an
element (tag, words of class, id and role, length and links of its own text) and of each parent-child pair form a tree;
messages up and down the tree (sum-product) give the exact marginals, and the text blocks of elements whose content
marginal is one half or more are the main text.

The weights are trained on a bounded sample of labelled pages (``SAMPLE``): pages that mark one ``article`` themselves
are labelled by it, and in half of them the mark is hidden, so that the model also learns from the rest. Training is
maximum likelihood with a normal prior around ``PRIOR``, which says what names such as "sidebar" mean before any page is
seen; without labelled pages the prior is the model.

Pages are parsed whole, in linear time, with the usual repairs (open paragraphs and list items, void elements, stray
ends). Closed buttons, selects, players, drawings and ``noscript`` are left out; where such an element is not closed, what
follows it counts. Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
a newline; ``br`` counts as white space. Null or empty pages give an empty text; repeated rows give equal texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import free_name, hash_sample, small_batches

SAMPLE = 150  # labelled pages that train the model
CONTENT, WRAPPER, OTHER = 0, 1, 2

# Element names as HTML groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # their content is no markup, up to their end tag or the page's end
SKIPPED = frozenset("noscript template svg canvas audio video select button".split())  # left out where they are closed
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
CLOSED_BY = {  # an open element that ends where one of these begins, unless one of the second set stands between
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th", "tr", "tbody"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody"}, {"table"}),
}
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip dropdown sitemap",
    "head": "header masthead topbar logo branding banner top",
    "foot": "footer copyright legal bottom colophon foot",
    "side": "sidebar side aside widget widgets related recommended trending popular more rail teaser teasers",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall disclaimer",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense banner",
    "form": "form search login signup register input contact",
    "reader": "comment comments reply replies discussion disqus respond reviews review feedback thread reader",
    "share": "share sharing social follow like likes tags tag meta byline author print tools",
    "hidden": "hidden",
    "main": "article content main post entry story body text articlebody maincontent prose",
}
GROUP_OF = {w: g for g, ws in NAMES.items() for w in ws.split()}
TAGS = sorted(BLOCKS)
LENGTHS = (0, 20, 60, 200)  # characters of an element's own text
FEATURES = [
    "any",
    *(f"tag:{t}" for t in TAGS),
    *(f"name:{g}" for g in NAMES),
    *(f"text:{k}" for k in range(5)),
    *(f"links:{k}" for k in range(3)),
    "sentences",
    "bare",
]
PLACE = {f: k for k, f in enumerate(FEATURES)}


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x state) and pair weights (parent x child) that the training starts from and is drawn to."""
    w = np.zeros((len(FEATURES), 3))

    def put(feature, content, wrapper, other):
        w[PLACE[feature]] = content, wrapper, other

    for tag in ("nav", "footer", "aside", "form", "dialog", "menu", "fieldset"):
        put(f"tag:{tag}", -4, -4, 4)
    put("tag:header", -0.5, -0.5, 0.7)
    put("tag:address", -1, -1, 1)
    put("tag:article", 5, 0, -3)
    put("tag:main", 2, 2, -3)
    put("tag:html", -3, 6, -3)
    put("tag:body", -3, 6, -3)
    put("tag:p", 1, -2, 0)
    for tag in ("h1", "h2", "h3", "blockquote", "pre"):
        put(f"tag:{tag}", 0.5, -2, 0)
    for group in ("menu", "foot", "side", "notice", "advert", "reader", "hidden"):
        put(f"name:{group}", -4, -4, 4)
    for group in ("head", "form", "share"):
        put(f"name:{group}", -2.5, -2.5, 2.5)
    put("name:main", 2, 1, -1.5)
    put("text:0", 0, 0.5, 0)
    put("text:1", -0.5, -1, 0.5)
    put("text:2", 0, -1, 0)
    put("text:3", 0.7, -1, -0.5)
    put("text:4", 1.5, -1, -1)
    put("links:2", -2, 0, 2)
    put("sentences", 0.7, 0, -0.7)
    put("bare", 10, 0, -2)
    pairs = np.log([[0.93, 0.01, 0.06], [0.3, 0.2, 0.5], [0.002, 0.002, 0.996]])  # what a parent of a state holds
    return w, pairs


# -- parsing -----------------------------------------------------------------------------------------------------------

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-label|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names_of(attributes: str) -> set[str]:
    """Groups of the words in class, id, role and label."""
    found = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            found.add("hidden")
        for word in PART.findall(value):
            if group := GROUP_OF.get(word.lower()):
                found.add(group)
    return found


class Page:
    """Block elements of a page in order: parents, tags, name groups, and the runs of text of each."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names = [-1], ["html"], [frozenset()]
        self.runs: list[tuple[int, str]] = []
        self.size, self.linked = [0], [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block each stands for or belongs to
        held: list[str] = []
        links = linked = 0

        def flush():
            nonlocal linked
            if held:
                text = " ".join(unescape("".join(held)).split())
                held.clear()
                if text:
                    node = stack[-1][1]
                    self.runs.append((node, text))
                    self.size[node] += len(text)
                    self.linked[node] += min(linked, len(text))
            linked = 0

        opened: dict[str, list[int]] = {}  # depths of the open elements of each name
        blocks: list[int] = []  # depths of the open block elements

        def push(tag, node):
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append((tag, node))

        def close(depth):
            nonlocal links
            if blocks and blocks[-1] >= depth:
                flush()
            while len(stack) > depth:
                name, _ = stack.pop()
                opened[name].pop()
                links -= name == "a"
            while blocks and blocks[-1] >= depth:
                blocks.pop()

        def end_open(ends, walls):
            """Close the outermost open element of ``ends`` that no wall shields."""
            wall = max((opened[w][-1] for w in walls - ends if opened.get(w)), default=0)
            inside = [depths[k] for e in ends if (depths := opened.get(e)) and (k := bisect_right(depths, wall)) < len(depths)]
            if inside:
                close(min(inside))

        at, n = 0, len(html)
        while at < n:
            start = html.find("<", at)
            if start < 0:
                start = n
            if start > at:
                piece = html[at:start]
                held.append(piece)
                if links > 0:
                    linked += len(piece.strip())
            if start == n:
                break
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(html, start) or LOOSE.match(html, start)
            if not m:
                if re.match(r"</?[a-zA-Z]", html[start : start + 3]):
                    break  # a tag that the end of the page cuts
                held.append("<")
                at = start + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                depth = opened[tag][-1] if opened.get(tag) else 0
                if depth and (tag in BLOCKS or not blocks or blocks[-1] < depth):  # the end of an inline element closes no block
                    close(depth)
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else n
                continue
            if tag in SKIPPED:
                if not m[3].endswith("/"):
                    end = re.compile(f"<(/?){tag}\\b[^>]*>?", re.I).search(html, at)
                    if end and end[1]:  # else it is not closed, and what follows counts
                        at = end.end()
                continue
            if tag == "head":
                continue
            if tag in VOID:
                if tag in ("br", "hr", "img"):
                    held.append(" ")
                if tag == "hr":
                    flush()
                continue
            if tag in CLOSES_P:
                end_open({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote"})
            if tag in CLOSED_BY:
                end_open(*CLOSED_BY[tag])
            if tag in BLOCKS:
                flush()
                if tag == "html":
                    continue
                self.parent.append(stack[-1][1])
                self.tag.append(tag)
                self.names.append(names_of(m[3]) if m[3] and not m[3].isspace() else frozenset())
                self.size.append(0)
                self.linked.append(0)
                push(tag, len(self.tag) - 1)
            else:
                links += tag == "a"
                push(tag, stack[-1][1])
        flush()

    def features(self, hide: frozenset[str] = frozenset()) -> list[list[int]]:
        out = []
        dots = [0] * len(self.tag)
        for node, text in self.runs:
            dots[node] += text.count(". ") + text.count("? ") + text.endswith((".", "!", "?", "。"))
        for k, tag in enumerate(self.tag):
            size = self.size[k]
            found = [0, PLACE[f"tag:{'div' if tag in hide else tag}"], PLACE[f"text:{0 if not size else sum(size > x for x in LENGTHS)}"]]
            found += [PLACE[f"name:{g}"] for g in self.names[k]]
            if size:
                share = self.linked[k] / size
                found.append(PLACE[f"links:{0 if share < 0.1 else 1 if share < 0.5 else 2}"])
            if dots[k] > 1:
                found.append(PLACE["sentences"])
            if tag in ("html", "body") and (size >= 60 or (size and k + 1 == len(self.tag))):
                found.append(PLACE["bare"])  # text without any element of its own
            out.append(found)
        return out

    def labels(self) -> list[int] | None:
        """States as the page's own single ``article`` tells them; None without one."""
        if self.tag.count("article") != 1:
            return None
        top = self.tag.index("article")
        state = [OTHER] * len(self.tag)
        for k in range(top, len(self.tag)):
            inside = k == top or (self.parent[k] >= top and state[self.parent[k]] == CONTENT)
            apart = self.tag[k] in ("nav", "footer", "aside", "form", "dialog") or bool(self.names[k] - {"main", "head"})
            state[k] = CONTENT if inside and (k == top or not apart) else OTHER
        up = self.parent[top]
        while up >= 0:
            state[up] = WRAPPER
            up = self.parent[up]
        return state


# -- inference and training --------------------------------------------------------------------------------------------


def add(a: float, b: float, c: float) -> float:
    top = max(a, b, c)
    return top + math.log(math.exp(a - top) + math.exp(b - top) + math.exp(c - top))


def beliefs(parent: list[int], unary: list[list[float]], pairs: list[list[float]]) -> tuple[list[list[float]], list[list[float]]]:
    """Log marginals (not normalised) of every element, and the messages each sent to its parent."""
    n = len(parent)
    inward = [list(u) for u in unary]
    sent = [[0.0, 0.0, 0.0]] * n
    (p00, p01, p02), (p10, p11, p12), (p20, p21, p22) = pairs
    for k in range(n - 1, 0, -1):
        a, b, c = inward[k]
        message = [add(p00 + a, p01 + b, p02 + c), add(p10 + a, p11 + b, p12 + c), add(p20 + a, p21 + b, p22 + c)]
        top = max(message)
        message = [x - top for x in message]
        sent[k] = message
        into = inward[parent[k]]
        into[0] += message[0]
        into[1] += message[1]
        into[2] += message[2]
    full = [inward[0]] + [None] * (n - 1)
    for k in range(1, n):
        above, mine = full[parent[k]], sent[k]
        a, b, c = above[0] - mine[0], above[1] - mine[1], above[2] - mine[2]
        top = max(a, b, c)
        a, b, c = a - top, b - top, c - top
        x, y, z = inward[k]
        full[k] = [x + add(a + p00, b + p10, c + p20), y + add(a + p01, b + p11, c + p21), z + add(a + p02, b + p12, c + p22)]
    return full, sent


def normal(log: list[float]) -> list[float]:
    top = max(log)
    e = [math.exp(x - top) for x in log]
    total = sum(e)
    return [x / total for x in e]


def unary_of(features: list[list[int]], weights: list[list[float]]) -> list[list[float]]:
    return [[sum(weights[f][s] for f in found) for s in range(3)] for found in features]


def trained(pages: list[Page], steps: int = 25, strength: float = 4.0) -> tuple[list[list[float]], list[list[float]]]:
    """Weights by gradient steps on the likelihood of labelled pages plus the prior (``strength`` pages' worth)."""
    w0, p0 = prior()
    weights, pairs = w0.copy(), p0.copy()
    data = []
    for k, page in enumerate(pages):
        if (state := page.labels()) is not None:
            data.append((page.parent, page.features(frozenset(["article"]) if k % 2 else frozenset()), state))
    if not data:
        return weights.tolist(), pairs.tolist()
    for _ in range(steps):
        dw, dp = np.zeros_like(weights), np.zeros_like(pairs)
        table, between = weights.tolist(), pairs.tolist()
        for parent, features, state in data:
            unary = unary_of(features, table)
            full, sent = beliefs(parent, unary, between)
            for k, found in enumerate(features):
                miss = -np.array(normal(full[k]))
                miss[state[k]] += 1
                dw[found] += miss / len(features)
                if k:
                    above = np.array(full[parent[k]]) - np.array(sent[k])
                    # Inward belief of k alone: its full belief less what came from above.
                    down = [add(*(above[s] + pairs[s, t] for s in range(3))) for t in range(3)]
                    joint = above[:, None] + pairs + (np.array(full[k]) - np.array(down))[None, :]
                    joint = np.exp(joint - joint.max())
                    dp -= joint / joint.sum() / len(features)
                    dp[state[parent[k]], state[k]] += 1 / len(features)
        weights += 2.0 * (dw - strength / 40 * (weights - w0)) / (len(data) + strength)
        pairs += 2.0 * (dp - strength / 40 * (pairs - p0)) / (len(data) + strength)
    return weights.tolist(), pairs.tolist()


def blocks_of(html: str, model) -> list[tuple[str, float]]:
    """Text blocks of a page in order, each with the probability that it is content."""
    weights, pairs = model
    page = Page(html)
    full, _ = beliefs(page.parent, unary_of(page.features(), weights), pairs)
    known: dict[int, list[float]] = {}
    out = []
    for node, text in page.runs:
        if node not in known:
            known[node] = normal(full[node])
        out.append((text, known[node][CONTENT]))
    return out


def extracted(df: DataFrame, html: str = "html", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` but ``html``, with ``blocks`` (text and content probability of each block) and ``main_text``."""
    spark = df.sparkSession
    marked = df.where(F.col(html).contains("<article")).select(html)
    marked = hash_sample(marked, [html], sample, marked.count())
    pages = [Page(h) for h in marked.toArrow().column(html).to_pylist()]
    sent = spark.sparkContext.broadcast(trained(pages))
    others = [c for c in df.columns if c != html]
    names = [free_name(df, "blocks"), free_name(df, "main_text")]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    schema = f"{kinds}{', ' if kinds else ''}{names[0]} array<struct<text:string,probability:double>>, {names[1]} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in small_batches(batches, html):
            blocks, texts = [], []
            for page in batch.column(len(others)).to_pylist():
                found = blocks_of(page or "", model)
                blocks.append([{"text": t, "probability": p} for t, p in found])
                texts.append("\n".join(t for t, p in found if p >= threshold))
            kind = pa.list_(pa.struct([("text", pa.string()), ("probability", pa.float64())]))
            new = [pa.array(blocks, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *new], names=[*others, *names])

    return df.select(*others, html).mapInArrow(run, schema)
