"""Dates from texts, serial numbers and durations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadspark.functions.nulls import col


def parse_date(text: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date, NULL if it does not fit."""
    return F.to_date(F.try_to_timestamp(col(text), F.lit(fmt)))


def from_serial(days: str | Column) -> Column:
    """Spreadsheet day number (text or number) to date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), col(days).try_cast("int"))


def five_year(year: str | Column) -> Column:
    """Nearest multiple of five, half to even."""
    return (F.bround(col(year).cast("double") / 5) * 5).cast("int")


def year_span(text: str | Column, repair: Mapping[str, int] | None = None) -> tuple[Column, Column]:
    """First and last year named in a duration text; a single year ends where it begins.

    ``repair`` maps an impossible four-digit text to the year to use for both ends.
    """
    years = F.regexp_extract_all(col(text), F.lit("[0-9]{4}"), F.lit(0))
    begin, second = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    end = F.when(F.size(years) == 1, begin).otherwise(second)
    first, last = begin.try_cast("int"), end.try_cast("int")
    for wrong, year in (repair or {}).items():
        last = F.when(begin == wrong, year).otherwise(last)
        first = F.when(begin == wrong, year).otherwise(first)
    return first, last


def years(first: int | Column, last: int | Column) -> Column:
    """Array of the years of a range."""
    lift = lambda y: F.lit(y) if isinstance(y, int) else y
    return F.sequence(lift(first), lift(last))
