"""Text parsing as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadspark.functions.nulls import col

NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"


def replace_first(text: str | Column, pattern: str, new: str) -> Column:
    """Replace only the first match."""
    return F.regexp_replace(col(text), rf"^(?s)(.*?)(?:{pattern})", f"$1{new}")


def unbracket(text: str | Column) -> Column:
    """Drop (bracketed) parts and surplus blanks."""
    return squish(F.regexp_replace(col(text), r"\([^()]*\)", ""))


def squish(text: str | Column) -> Column:
    """Trim, and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(col(text), r"[ \t\n\f\r]+", " "))


def drop_end(text: str | Column, n: int = 1) -> Column:
    """Text without its last n characters."""
    return F.substring(col(text), F.lit(1), F.greatest(F.length(col(text)) - n, F.lit(0)))


def number(text: str | Column) -> Column:
    """Number with comma or blank thousands separators; anything else is NULL."""
    return F.regexp_replace(col(text), "[, ]", "").try_cast("double")


def additive_length(text: str | Column) -> Column:
    """Length with a decimal comma or a sum of parts: ``3,7`` or ``33+130``; NULL if a part is no number."""
    parts = F.transform(F.split(col(text), r"\+"), lambda p: F.trim(F.replace(p, F.lit(","), F.lit("."))).try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p)


def two_names(text: str | Column) -> tuple[Column, Column]:
    """Both names of an ``A - B`` text."""
    pattern = r"^\s*(.+?)\s+-\s+(.+?)\s*$"
    return (F.nullif(F.regexp_extract(col(text), pattern, i), F.lit("")) for i in (1, 2))


def neighbour_lengths(text: str | Column) -> Column:
    """``Algeria 41 km, Mauritania 1,564 km`` to an array of (neighbour, km).

    A comma followed by a blank separates entries; a comma between digits separates thousands; lengths may have
    decimals; bracketed parts of a name are kept.
    """
    entries = F.split(col(text), r",\s+")
    pattern = rf"^\s*(.*?)\s+({NUMBER})\s+km"
    parsed = F.transform(
        entries,
        lambda e: F.struct(
            F.nullif(F.regexp_extract(e, pattern, 1), F.lit("")).alias("neighbour"),
            number(F.regexp_extract(e, pattern, 2)).alias("km"),
        ),
    )
    return F.filter(parsed, lambda e: e["neighbour"].isNotNull())


def quantity(text: str | Column) -> Column:
    """First number of a text times its unit word (thousand, million, billion, trillion)."""
    m = rf"({NUMBER})(?:\s+(thousand|million|billion|trillion))?"
    unit = F.regexp_extract(col(text), m, 2)
    factor = (
        F.when(unit == "thousand", 1e3).when(unit == "million", 1e6).when(unit == "billion", 1e9).when(unit == "trillion", 1e12)
    ).otherwise(1.0)
    return number(F.regexp_extract(col(text), m, 1)) * factor


def number_text(x: str | Column, digits: int = 3) -> Column:
    """Rounded number as text without trailing zeros."""
    fixed = F.when(col(x).isNotNull(), F.format_string(f"%.{digits}f", col(x)))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def stars(p: str | Column) -> Column:
    """Significance mark of a p-value."""
    v = col(p)
    return F.when(v < 0.001, "***").when(v < 0.01, "**").when(v < 0.05, "*").when(v < 0.1, ".").when(v.isNotNull(), "")


def estimate_cells(coef: str | Column, se: str | Column, p: str | Column) -> tuple[Column, Column]:
    """Table cells ``coef***`` and ``(se)``; the weakest mark is left out."""
    mark = F.when(stars(p) == ".", "").otherwise(stars(p))
    return F.concat(number_text(coef), mark), F.concat(F.lit("("), number_text(se), F.lit(")"))


def first_of(text: str | Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL without one."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def all_of(text: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def listed_to_null(text: str | Column, marks: Sequence[str]) -> Column:
    """Strings that stand for a missing value become NULL."""
    return F.when(~col(text).isin(list(marks)), col(text))
