"""Country-period panels and harmonised multi-source tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions import dates as Y
from dyadspark.functions.nulls import half_even, percent, right_most, safe_div, sum_strict, sum_where
from dyadspark.functions.text import number, unbracket
from dyadspark.operators.aggregates import n_rows
from dyadspark.operators.codes import patch_keyed
from dyadspark.operators.joins import complete_panel, left_fill
from dyadspark.operators.ordered import fill_down, first_per_group, running
from dyadspark.operators.reshape import longer, pivot_by_source, wider

SOURCE_COLUMNS = ["state1", "state2", "year", "indicator", "source"]


def modal_family(wide: DataFrame, key: str, cols: Sequence[str], families: Mapping[str, str]) -> DataFrame:
    """Largest family per key from one population column per denomination; unlisted names are their own family."""
    long = longer(wide, [key], cols, "member", "people")
    family = F.coalesce(*[F.when(F.col("member") == m, f) for m, f in families.items()], F.col("member"))
    sums = long.groupBy(key, family.alias("family")).agg(sum_strict("people").alias("people"))
    known = sums.where(F.col("people").isNotNull())
    return first_per_group(known, [key], [F.desc("people"), F.asc("family")])


def incident_panel(incidents: DataFrame, pairs: DataFrame, key: str, period: str) -> DataFrame:
    """Incidents and victims per key and period, completed with zeros, on both ends of each pair and period.

    ``incidents`` has one row per incident with (key, period, victims).
    """
    counts = incidents.groupBy(key, period).agg(
        n_rows().alias("n"), F.coalesce(F.sum("victims"), F.lit(0)).cast("double").alias("toll")
    )
    panel = complete_panel(counts, [key], period, {"n": 0, "toll": 0.0})
    out = None
    for end in (1, 2):
        side = panel.select(
            F.col(key).alias(f"state{end}"), period, F.col("n").alias(f"n{end}"), F.col("toll").alias(f"toll{end}")
        )
        out = pairs.join(side, "state1") if out is None else out.join(side, ["state2", period])
    return out.withColumns({f"{c}_log": F.log1p(c) for c in ("n1", "n2", "toll1", "toll2")})


def timeline(df: DataFrame, period: str, length: str | Column) -> DataFrame:
    """Number and total length per calendar period with running totals."""
    per = df.groupBy(period).agg(n_rows().alias("n"), sum_strict(length).alias("length"))
    return running(per, [], [period], cum_n="n", cum_length="length")


def decision_rates(long: DataFrame, keys: Sequence[str], total: str, positive: str, rejected: str) -> DataFrame:
    """Decisions (keys, decision, value) to one row with rejection and recognition rates in percent."""
    wide = wider(long, keys, "decision", "value", [total, positive, rejected])
    return wide.withColumns(
        {
            "rejection_rate": percent(F.col(total) - F.col(positive), F.col(total)),
            "recognition_rate": percent(F.col(total) - F.col(rejected), F.col(total)),
        }
    )


def party_share(elections: DataFrame, minimum: float) -> DataFrame:
    """Vote share right of a threshold per country and year of the nearest turn of the year.

    ``elections`` is (state, day, share, position). Where several elections fall into one year the last one counts. A day
    without any known share has none.
    """
    known = F.count("share") > 0
    share = F.when(known, sum_where("share", F.col("position") > minimum))
    per_day = elections.groupBy("state", "day").agg(share.alias("right_share"))
    near = per_day.withColumn("year", F.year("day") + (F.month("day") > 6).cast("int"))
    return first_per_group(near, ["state", "year"], [F.desc("day")]).drop("day")


def country_year_panel(
    applicants: DataFrame,
    decisions: DataFrame,
    population: DataFrame,
    lawsuits: DataFrame,
    shares: DataFrame,
    checks: DataFrame,
) -> DataFrame:
    """Country-year panel: applications, rates, per 1000 people, event counts, carried-forward party share.

    ``lawsuits`` and ``checks`` are event counts (state, year, n); years without an entry count zero.
    """
    keys = ["state", "year"]
    panel = applicants.join(decisions, keys, "left").join(population, "state", "left")
    panel = panel.withColumn("per1000", half_even(safe_div("applicants", F.col("pop") / 1000), 2))
    panel = left_fill(panel, lawsuits.withColumnRenamed("n", "lawsuits"), keys, {"lawsuits": 0})
    carried = fill_down(panel.select(*keys).join(shares, keys, "full"), "year", ["right_share"], ["state"])
    panel = panel.join(carried, keys, "left")
    return left_fill(panel, checks.withColumnRenamed("n", "checks"), keys, {"checks": 0})


def base_group(panel: DataFrame, key: str, period: str, base: int, rule: Column, name: str = "group") -> DataFrame:
    """A group found by a rule in one base period and carried to all periods of the key."""
    groups = panel.where(F.col(period) == base).select(key, rule.alias(name))
    return panel.join(groups, key, "left")


def within_t(t: float, df: int) -> float:
    """Chance that Student's t lies within +-t, by the finite series for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    term, total = (math.cos(angle), 0.0) if df % 2 else (1.0, 0.0)
    for k in range(df // 2):
        total += term
        term *= cos2 * ((2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2))
    return (angle + math.sin(angle) * total) * 2 / math.pi if df % 2 else math.sin(angle) * total


def t_quantile(level: float, df: int) -> float:
    """Half-width in standard errors of a two-sided interval: halved until two neighbours in floating point remain."""
    low, high = 0.0, 1.0
    while within_t(high, df) < level:
        high *= 2
    while low < (middle := (low + high) / 2) < high:
        low, high = (middle, high) if within_t(middle, df) < level else (low, middle)
    return high


def student_t(level: float, df: Column) -> Column:
    """Two-sided quantile of Student's t: exact to 200 degrees of freedom, above by expansion (error below 1e-10).

    Between whole degrees of freedom it is linear in 1/df (error below 1e-3 from 5 on, 1e-6 from 30 on), below one it is
    that of one. NULL where no degree of freedom is left.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    large = reduce(lambda acc, it: acc + F.lit(it[1]) / F.pow(df, it[0]), enumerate(terms, 1), F.lit(z))
    known = F.array(*[F.lit(t_quantile(level, n)) for n in range(1, 202)])
    whole = F.greatest(F.floor(df), F.lit(1)).cast("int")
    below, above = F.get(known, whole - 1), F.get(known, whole)
    share = F.greatest(F.lit(0.0), (1 / whole - 1 / df) * whole * (whole + 1))
    return F.when(df <= 0, None).when(df <= 200, below + (above - below) * share).otherwise(large)


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, level: float = 0.95) -> DataFrame:
    """Least-squares line per group at the observed x values with standard error and confidence band.

    A group with one x value has no line; one with two points has a line without error and band.
    """
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("mx"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )
    at = df.select(*keys, x).distinct().join(fit, list(keys))
    rest = F.col("n") - 2
    left = F.greatest(F.col("syy") - safe_div(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    s2 = F.when(F.col("sxx") > 0, safe_div(left, F.when(rest > 0, rest)))
    se = F.sqrt(s2 * (safe_div(F.lit(1.0), F.col("n")) + safe_div(F.pow(F.col(x) - F.col("mx"), 2), F.col("sxx"))))
    half = student_t(level, rest) * F.col("se")
    return (
        at.withColumn("fit", F.col("intercept") + F.col("slope") * F.col(x))
        .withColumn("se", se)
        .withColumns({"low": F.col("fit") - half, "high": F.col("fit") + half})
        .select(*keys, x, "fit", "se", "low", "high")
    )


def route_flows(wide: DataFrame, ids: Sequence[str], route: str, months: Sequence[str], names: Mapping[str, str], rest: str) -> DataFrame:
    """Monthly columns headed by spreadsheet day numbers to yearly sums per route, other routes pooled.

    Pooled routes are summed, so every route counts.
    """
    long = longer(wide, ids, months, "serial", "crossings")
    yearly = long.groupBy(route, F.year(Y.from_serial("serial")).alias("year")).agg(sum_strict("crossings").alias("crossings"))
    label = F.coalesce(*[F.when(F.col(route) == k, v) for k, v in names.items()], F.lit(rest))
    return yearly.groupBy(label.alias("route"), "year").agg(sum_strict("crossings").alias("crossings"))


def merge_reports(reports: Sequence[DataFrame], name: str, value: str) -> DataFrame:
    """Yearly reports with number texts and bracketed row names, joined on the name and made long."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(unbracket(name).alias(name), *[number(c).alias(c) for c in df.columns if c != name])

    joined = reduce(lambda a, b: a.join(b, name, "left"), [tidy(r) for r in reports])
    years = [c for c in joined.columns if c != name]
    return longer(joined, [name], years, "year", value).withColumn("year", F.col("year").cast("int"))


def capacity_list(texts: DataFrame, numbers: DataFrame, land1: str, land2: str) -> DataFrame:
    """Two lists (place, capacity), one with texts, as one list of ``place, country`` labels."""
    parsed = texts.select(
        F.concat(F.regexp_extract("place", r"^(\p{Alpha}+)", 1), F.lit(f", {land1}")).alias("place"),
        number("capacity").alias("capacity"),
    )
    plain = numbers.select(F.concat("place", F.lit(f", {land2}")).alias("place"), F.col("capacity").cast("double"))
    return parsed.unionByName(plain)


def harmonise(df: DataFrame, source: str, state1: str, state2: str, year: str | Column, indicator: str) -> DataFrame:
    """One source brought to the common columns; the year is kept as text."""
    when = F.col(year) if isinstance(year, str) else year
    return df.select(
        F.col(state1).alias("state1"),
        F.col(state2).alias("state2"),
        when.cast("string").alias("year"),
        F.lit(indicator).alias("indicator"),
        F.lit(source).alias("source"),
    )


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.select(*SOURCE_COLUMNS) for s in sources])


def count_sources(barriers: DataFrame) -> DataFrame:
    """Number of entries per ordered pair."""
    return barriers.groupBy("state1", "state2").agg(n_rows().alias("n"))


def best_source_year(
    pairs: DataFrame, barriers: DataFrame, priority: Sequence[str], patches: Sequence[Mapping] = ()
) -> DataFrame:
    """Year per pair from the most preferred source (last in ``priority``), then corrections by key."""
    years = barriers.withColumn("year", F.col("year").try_cast("int"))
    wide = pivot_by_source(years, ["state1", "state2"], "source", "year", priority)
    built = wide.select("state1", "state2", right_most(*[F.col(f"`{p}`") for p in priority]).alias("built"))
    return patch_keyed(pairs.join(built, ["state1", "state2"], "left"), patches, ["state1", "state2"])
