"""Dictionaries of patterns found in texts in one pass, whatever their number.

Every pattern has literal cores: strings of which one must stand in a text that the pattern matches. An automaton over
the cores of all patterns reads a text once; only a pattern whose core was met is then tried itself. Patterns without a
core (such as ``[0-9]+``) are tried on every text. Patterns are Python regular expressions; texts are compared as they
come, so lower-case them first where case does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as kinds
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CASE = re.IGNORECASE | re.VERBOSE


def _longest_run(items) -> str | None:
    """The longest literal that every match of a sequence holds."""
    runs, now = [], ""
    for op, value in items:
        if op is kinds.LITERAL:
            now += chr(value)
            continue
        if op is kinds.AT:
            continue  # takes no letters
        runs.append(now)
        now = ""
        if op is kinds.SUBPATTERN and not value[1]:
            runs.append(_longest_run(value[3]) or "")
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
            runs.append(_longest_run(value[2]) or "")
    best = max([*runs, now], key=len)
    return best or None


def cores(pattern: str) -> list[str] | None:
    """Literals of which one stands in every match; None if there are no such literals."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & CASE:
        return None
    whole = _longest_run(parsed)
    if whole:
        return [whole]
    if len(parsed) == 1 and parsed[0][0] is kinds.BRANCH:
        found = [_longest_run(branch) for branch in parsed[0][1][1]]
        return found if all(found) else None
    return None


def is_literal(pattern: str) -> bool:
    return bool(pattern) and all(op is kinds.LITERAL for op, _ in _parser.parse(pattern))


class Dictionary:
    """The automaton over the cores of some patterns."""

    def __init__(self, patterns: Sequence[str]):
        import ahocorasick

        self.compiled = [re.compile(p) for p in patterns]
        self.plain = [is_literal(p) for p in patterns]
        owners: dict[str, list[int]] = {}
        self.always = []
        for i, p in enumerate(patterns):
            for core in cores(p) or []:
                owners.setdefault(core, []).append(i)
            if cores(p) is None:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for core, some in owners.items():
            self.automaton.add_word(core, (len(core), some))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def _hits(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """Start, end and patterns of every core in the text, overlapping ones too."""
        if not self.empty:
            for last, (size, some) in self.automaton.iter(text):
                yield last + 1 - size, last + 1, some

    def first(self, text: str) -> int | None:
        """The first pattern (in the order given) that is found in the text."""
        tried = {i for _, _, some in self._hits(text) for i in some} | set(self.always)
        return next((i for i in sorted(tried) if self.compiled[i].search(text)), None)

    def all(self, text: str) -> list[str]:
        """What the patterns match, by place: per start the longest match, matches that overlap in their order."""
        best: dict[int, int] = {}
        tried = set(self.always)
        for start, end, some in self._hits(text):
            for i in some:
                if self.plain[i]:
                    best[start] = max(end, best.get(start, 0))
                else:
                    tried.add(i)
        for i in tried:
            for m in self.compiled[i].finditer(text):
                if m.end() > m.start():
                    best[m.start()] = max(m.end(), best.get(m.start(), 0))
        return [text[a : best[a]] for a in sorted(best)]


def first_match(text: Column, patterns: Sequence[str], codes: Sequence) -> Column:
    """The code of the first pattern found in a text; NULL for none and for a NULL text."""
    patterns = list(patterns)

    def job(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Dictionary(patterns)
        for part in parts:
            yield pd.Series([None if t is None else known.first(t) for t in part], dtype="Int32")

    place = F.pandas_udf(job, "int")(text)
    return F.get(F.array(*[F.lit(c) for c in codes]), place)


def all_matches(text: Column, patterns: Sequence[str]) -> Column:
    """All that the patterns match in a text, in order of appearance; NULL for a NULL text."""
    patterns = list(patterns)

    def job(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Dictionary(patterns)
        for part in parts:
            yield pd.Series([None if t is None else known.all(t) for t in part], dtype=object)

    return F.pandas_udf(job, "array<string>")(text)
