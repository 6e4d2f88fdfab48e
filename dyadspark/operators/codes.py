"""Code systems: crosswalks, name dictionaries, keyed corrections and lookups.

Dimension sides are left to Spark's size-checked automatic broadcast; corrections written in a program are turned into
expressions and dictionaries of names into one automaton, so they never shuffle the large side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.dictionary import all_matches, first_match
from dyadspark.functions.nulls import col
from dyadspark.operators.ordered import first_per_group, join_same
from dyadspark.session import stored


def literal_map(values: Mapping) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def recode(
    df: DataFrame, c: str, crosswalk: DataFrame, origin: str, target: str, name: str, overrides: Mapping | None = None
) -> DataFrame:
    """Translate codes by a crosswalk (one row per origin code); overrides win, unmatched codes give NULL."""
    walk = crosswalk.select(F.col(origin).alias("_from"), F.col(target).alias("_to"))
    code = F.col("_to")
    if overrides:
        code = F.coalesce(F.element_at(literal_map(overrides), F.col(c)), code)
    return df.join(walk, F.col(c) == F.col("_from"), "left").withColumn(name, code).drop("_from", "_to")


def name_code(name: str | Column, dictionary: Sequence[tuple[str, str]], overrides: Mapping | None = None) -> Column:
    """Code of the first (lower-case) dictionary pattern found in a free-text name; overrides are whole names."""
    found = first_match(F.lower(col(name)), [p for p, _ in dictionary], [code for _, code in dictionary])
    fixed = [F.when(col(name) == k, F.lit(v)) for k, v in (overrides or {}).items()]
    return F.coalesce(*fixed, found)


def recode_name(
    df: DataFrame, c: str, dictionary: Sequence[tuple[str, str]], name: str, overrides: Mapping | None = None
) -> DataFrame:
    """Free-text names to codes; each distinct name is matched against the dictionary once."""
    codes = df.select(c).distinct().withColumn(name, name_code(c, dictionary, overrides))
    return join_same(df, stored(codes), [c])


def unmatched(df: DataFrame, c: str, crosswalk: DataFrame, origin: str) -> DataFrame:
    """Codes without a counterpart, with their number of rows."""
    codes = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return codes.join(crosswalk.select(F.col(origin).alias(c)), c, "left_anti")


def mentions(text: str | Column, words: Sequence[str]) -> Column:
    """All dictionary patterns found in a lower-cased text, in order of appearance.

    Per place the longest one counts, and words that overlap are all found. The text is read once, however many words
    there are.
    """
    return all_matches(F.lower(col(text)), words)


def longer_list(a: str | Column, b: str | Column) -> Column:
    """The second list where it has more entries, else the first."""
    return F.when(F.size(col(a)) < F.size(col(b)), col(b)).otherwise(col(a))


def patch_keyed(df: DataFrame, patches: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """Overwrite cells of listed keys. Each patch maps key columns and new values; a value may be NULL."""
    for c in dict.fromkeys(c for p in patches for c in p if c not in keys):
        value = F.col(c)
        for p in patches:
            if c in p:
                hit = [F.col(k) == F.lit(p[k]) for k in keys]
                cond = hit[0]
                for h in hit[1:]:
                    cond = cond & h
                value = F.when(cond, F.lit(p[c])).otherwise(value)
        df = df.withColumn(c, value)
    return df


def fill_where(df: DataFrame, c: str, cond: Column, value) -> DataFrame:
    """Set a value only where the column is missing and a condition on other columns holds."""
    return df.withColumn(c, F.when(cond & F.col(c).isNull(), F.lit(value)).otherwise(F.col(c)))


def lookup_first(
    df: DataFrame, c: str, table: DataFrame, key: str, attrs: Mapping[str, str], order: Sequence[Column]
) -> DataFrame:
    """Attributes of the first matching row only, so the left side never fans out."""
    one = first_per_group(table, [key], order).select(
        F.col(key).alias("_key"), *[F.col(a).alias(n) for a, n in attrs.items()]
    )
    return df.join(one, F.col(c) == F.col("_key"), "left").drop("_key")
