"""Missing-value rules, stated once.

A NULL in a sum either poisons it (``sum_strict``) or counts as nothing (``sum0``); division by zero and
logarithms outside their domain give NULL; list membership never drops NULL rows unless asked to.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_strict(c: str | Column) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.sum(col(c)))


def sum0(c: str | Column) -> Column:
    """Sum that skips NULL and is 0 for nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def sum_where(c: str | Column, cond: Column) -> Column:
    """Sum over the rows that satisfy a condition, 0 for none."""
    return F.coalesce(F.sum(F.when(cond, col(c))), F.lit(0))


def safe_div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def percent(a: str | Column, b: str | Column) -> Column:
    return safe_div(col(a) * 100, b)


def in_list(c: str | Column, values: Iterable) -> Column:
    return col(c).isin(list(values))


def not_in_list(c: str | Column, values: Iterable) -> Column:
    """Not in the list; NULL rows stay."""
    return col(c).isNull() | ~col(c).isin(list(values))


def na_if(c: str | Column, values: Iterable) -> Column:
    """Listed values become NULL."""
    return F.when(~col(c).isin(list(values)), col(c))


def flag(cond: Column) -> Column:
    """1 / 0, NULL where the condition is unknown."""
    return F.when(cond, 1).when(~cond, 0)


def row_min(a: str | Column, b: str | Column) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))


def row_max(a: str | Column, b: str | Column) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a), col(b)))


def same(a: Column, b: Column) -> Column:
    """Equality in which NULL equals NULL."""
    return a.eqNullSafe(b)


def right_most(*cols: str | Column) -> Column:
    """Last non-NULL of the columns, the most preferred given last."""
    return F.coalesce(*[col(c) for c in reversed(cols)])


def half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def money(c: str | Column) -> Column:
    """Two-decimal amount whose sums do not depend on the order of addition."""
    return col(c).cast("decimal(18,2)")
