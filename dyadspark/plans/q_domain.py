"""Composite analyses of pairs and panels."""

from pyspark.sql import functions as F

from dyadspark.functions import nulls as N
from dyadspark.operators import aggregates as A
from dyadspark.operators import codes as K
from dyadspark.operators import dyads as D
from dyadspark.operators import joins as J
from dyadspark.operators import ordered as O
from dyadspark.operators import panel as P
from dyadspark.operators import tables as T
from dyadspark.plans import base as B
from dyadspark.plans.q_aggregates import _order_regions
from dyadspark.plans.q_codes import PANEL_SQL
from dyadspark.plans.registry import query
from dyadspark.session import stored

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "modal_family",
    """SELECT c_nationkey, family, people FROM (SELECT c_nationkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'house'
      ELSE c_mktsegment END AS family, count(*) AS people FROM customer GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY people DESC, family) = 1""",
)
def modal_family(t):
    counts = A.count_by(t.customer, "c_nationkey", "c_mktsegment")
    wide = counts.groupBy("c_nationkey").pivot("c_mktsegment", SEGMENTS).agg(F.first("n")).fillna(0)
    return P.modal_family(wide, "c_nationkey", SEGMENTS, {"BUILDING": "house", "FURNITURE": "house"})


@query(
    "incident_panel",
    "WITH " + PANEL_SQL + "," + B.FLOWS_SQL + """,
    ev AS (SELECT c_nationkey AS state, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n,
      CAST(coalesce(sum(CAST(CASE WHEN event_type = 'error' THEN value END AS DECIMAL(18,2))), 0) AS DOUBLE) AS toll
      FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL),
    full_ev AS (SELECT k.state, d.day, coalesce(n, 0) AS n, coalesce(toll, 0) AS toll FROM (SELECT DISTINCT state FROM ev) k,
      (SELECT DISTINCT day FROM ev) d LEFT JOIN ev e ON e.state = k.state AND e.day = d.day),
    pairs AS (SELECT DISTINCT state1, state2 FROM flows WHERE state1 <> state2)
    SELECT state1, state2, a.day, a.n AS n1, a.toll AS toll1, b.n AS n2, b.toll AS toll2, round(ln(1 + a.n), 4) AS n1_log,
      round(ln(1 + b.n), 4) AS n2_log, round(ln(1 + a.toll), 4) AS toll1_log, round(ln(1 + b.toll), 4) AS toll2_log
    FROM pairs JOIN full_ev a ON a.state = state1 JOIN full_ev b ON b.state = state2 AND b.day = a.day""",
)
def incident_panel(t):
    incidents = t.events.join(t.customer, F.col("c_custkey") == F.col("user_id")).select(
        F.col("c_nationkey").alias("state"),
        F.to_date("ts").cast("string").alias("day"),
        F.when(F.col("event_type") == "error", N.money("value")).alias("victims"),
    )
    pairs = B.flows(t).where(F.col("state1") != F.col("state2")).select("state1", "state2").distinct()
    panel = P.incident_panel(incidents, pairs, "state", "day")
    return panel.withColumns({c: F.round(c, 4) for c in panel.columns if c.endswith("_log")})


@query(
    "in_out_flows",
    "WITH " + B.INFO_SQL + "," + B.FLOWS_SQL + """,
    v AS (SELECT state2 AS host, state1 AS origin, CAST(sum(flow) AS DOUBLE) AS v FROM flows GROUP BY ALL),
    w AS (SELECT host, origin, v, CAST(sum(CAST(v AS DECIMAL(28,2))) OVER (PARTITION BY host) AS DOUBLE) AS agg FROM v)
    SELECT i.host AS state1, i.origin AS state2, i.v AS incoming, i.agg AS incoming_agg, o.v AS outgoing, o.agg AS outgoing_agg,
      round(i.v / a.pop, 4) AS incoming_pc, round(i.agg / a.pop, 4) AS incoming_agg_pc, round(o.v / b.pop, 4) AS outgoing_pc,
      round(ln(1 + i.v), 4) AS incoming_log, round(ln(1 + o.agg / b.pop), 4) AS outgoing_agg_pc_log
    FROM w i LEFT JOIN w o ON o.origin = i.host AND o.host = i.origin
    LEFT JOIN info a ON a.state = i.host LEFT JOIN info b ON b.state = i.origin""",
)
def in_out_flows(t):
    moves = B.flows(t).select(F.col("state2").alias("host"), F.col("state1").alias("origin"), "flow")
    both = D.in_out_flows(moves, stored(B.info(t).select("state", "pop")))
    rounded = ["incoming_pc", "incoming_agg_pc", "outgoing_pc", "incoming_log", "outgoing_agg_pc_log"]
    return both.select(
        "state1", "state2", "incoming", "incoming_agg", "outgoing", "outgoing_agg", *[F.round(c, 4).alias(c) for c in rounded]
    )


@query(
    "mirror_dedup_join",
    "WITH " + B.FLOWS_SQL + """,
    geo AS (SELECT state1, state2, year, CAST(flow AS DOUBLE) AS distance FROM flows WHERE state1 < state2),
    both_ways AS (SELECT * FROM geo UNION ALL SELECT state2, state1, year, distance FROM geo),
    one AS (SELECT state1 || '_' || state2 AS dyad, distance FROM both_ways QUALIFY row_number() OVER (PARTITION BY state1, state2 ORDER BY year) = 1)
    SELECT f.state1, f.state2, f.year, distance FROM flows f LEFT JOIN one ON dyad = f.state1 || '_' || f.state2""",
)
def mirror_dedup_join(t):
    flows = stored(B.flows(t))  # a few rows per pair and year, used twice
    directed = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("_"), F.col(b).cast("string"))
    geo = flows.where(F.col("state1") < F.col("state2")).select("state1", "state2", "year", F.col("flow").cast("double").alias("distance"))
    one = O.first_per_group(
        D.mirror(geo, [("state1", "state2")]).withColumn("dyad", directed("state1", "state2")), ["dyad"], [F.asc("year")]
    )
    keyed = flows.select("state1", "state2", "year", directed("state1", "state2").alias("dyad"))
    return J.natural_left(keyed, one.select("dyad", "distance")).drop("dyad")


@query(
    "neighbour_profile",
    "WITH " + B.DYADS_SQL + """ SELECT typology, count(*) AS n, round(avg(wealth2), 4) AS mean_wealth, round(median(wealth2), 4) AS median_wealth,
      round(avg(abs(wealth1 - wealth2)), 4) AS mean_gap_wealth, round(median(abs(wealth1 - wealth2)), 4) AS median_gap_wealth,
      count(wealth1 + wealth2) AS n_wealth, round(avg(polity2), 4) AS mean_polity, CAST(median(polity2) AS DOUBLE) AS median_polity,
      round(avg(abs(polity1 - polity2)), 4) AS mean_gap_polity, CAST(median(abs(polity1 - polity2)) AS DOUBLE) AS median_gap_polity,
      count(polity1 + polity2) AS n_polity FROM full_dyads GROUP BY 1""",
)
def neighbour_profile(t):
    pairs = stored(B.full_dyads(t))  # one row per pair of countries
    prof = D.neighbour_profile(pairs, "typology", {"wealth": ("wealth1", "wealth2"), "polity": ("polity1", "polity2")})
    return prof.withColumns({c: F.round(c, 4) for c in prof.columns if "wealth" in c and not c.startswith("n_") or c.startswith("mean")})


@query(
    "direction_share",
    "WITH " + B.DYADS_SQL + """ SELECT typology, round(sum(CASE WHEN wealth1 >= wealth2 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS share_wealth,
      round(sum(CASE WHEN polity1 >= polity2 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS share_polity FROM full_dyads
      WHERE wealth1 IS NOT NULL AND wealth2 IS NOT NULL AND polity1 IS NOT NULL AND polity2 IS NOT NULL GROUP BY 1""",
)
def direction_share(t):
    s = D.direction_share(B.full_dyads(t), "typology", {"wealth": ("wealth1", "wealth2"), "polity": ("polity1", "polity2")})
    return s.withColumns({c: F.round(c, 4) for c in ("share_wealth", "share_polity")})


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SHARE = "round_even(CAST(coalesce(max(n) FILTER (region = '{r}'), 0) AS DOUBLE) * 100 / (SELECT sum(n) FROM c x WHERE x.region = '{r}'), 1) AS \"{r}\""
DIST_SQL = """WITH j AS (SELECT r_name AS region, o_orderpriority AS typology FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT region, typology, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'World', typology, count(*) FROM j GROUP BY 2),
    d AS (SELECT typology, """ + ", ".join(SHARE.format(r=r) for r in [*REGIONS, "World"]) + " FROM c GROUP BY 1)"


@query("typology_dist", DIST_SQL + " SELECT * FROM d UNION ALL SELECT 'Total', "
       + ", ".join(f'round(sum("{r}"), 4)' for r in [*REGIONS, "World"]) + " FROM d WHERE typology IN ('1-URGENT', '2-HIGH')")
def typology_dist(t):
    table = T.distribution(_order_regions(t), "region", "typology", REGIONS)
    total = T.selected_total(table, "typology", ["1-URGENT", "2-HIGH"]).where(F.col("typology") == "Total")
    return table.unionByName(total.withColumns({r: F.round(r, 4) for r in [*REGIONS, "World"]}))


@query(
    "unequal_pairs",
    "WITH " + B.DYADS_SQL + """, k AS (SELECT least(name1, name2) || '_' || greatest(name1, name2) AS dyad, abs(wealth1 - wealth2) AS gap
      FROM full_dyads) SELECT DISTINCT dyad, gap FROM k WHERE gap IS NOT NULL ORDER BY gap DESC, dyad LIMIT 25""",
)
def unequal_pairs(t):
    pairs = B.full_dyads(t).select(F.col("name1").alias("state1"), F.col("name2").alias("state2"), "wealth1", "wealth2")
    return D.unequal_pairs(pairs, "wealth1", "wealth2", 25)


KINDS_SQL = B.SHIPMENTS_SQL + ", kinds AS (SELECT state1, state2, year, typology, count(*) AS n FROM ship GROUP BY ALL)"
SOURCES_SQL = KINDS_SQL + """,
barriers AS (SELECT state1, state2, CAST(year AS VARCHAR) AS year, 'wall' AS indicator, 'urgent' AS source FROM kinds WHERE typology = '1-URGENT'
  UNION ALL SELECT state1, state2, CAST(year + 1 AS VARCHAR), 'fence', 'high' FROM kinds WHERE typology = '2-HIGH' AND state1 < state2
  UNION ALL SELECT state2, state1, CAST(year + 1 AS VARCHAR), 'fence', 'high' FROM kinds WHERE typology = '2-HIGH' AND state1 < state2
  UNION ALL SELECT state1, state2, NULL, 'barrier', 'low' FROM kinds WHERE typology = '5-LOW')"""


def barrier_sources(t, kinds=None):
    """Three differently shaped lists of barriers in the common form."""
    kinds = B.kinds(t) if kinds is None else kinds
    one = kinds.where(F.col("typology") == "1-URGENT").selectExpr("state1 AS builder", "state2 AS target", "year AS begin")
    two = kinds.where((F.col("typology") == "2-HIGH") & (F.col("state1") < F.col("state2"))).selectExpr("state1 AS a", "state2 AS b", "year + 1 AS y")
    three = kinds.where(F.col("typology") == "5-LOW")
    return [
        P.harmonise(one, "urgent", "builder", "target", "begin", "wall"),
        P.harmonise(D.mirror(two, [("a", "b")]), "high", "a", "b", "y", "fence"),
        P.harmonise(three, "low", "state1", "state2", F.lit(None), "barrier"),
    ]


@query(
    "source_union",
    "WITH " + SOURCES_SQL + """ SELECT b.*, n FROM barriers b JOIN (SELECT state1, state2, count(*) AS n FROM barriers GROUP BY ALL) USING (state1, state2)""",
)
def source_union(t):
    barriers = P.union_sources(barrier_sources(t))
    return barriers.join(P.count_sources(barriers), ["state1", "state2"])


@query(
    "best_source_year",
    "WITH " + SOURCES_SQL + """, y AS (SELECT state1, state2, min(CAST(year AS INT)) FILTER (source = 'urgent') AS u,
      min(CAST(year AS INT)) FILTER (source = 'high') AS h FROM barriers GROUP BY ALL)
    SELECT p.state1, p.state2, CASE WHEN p.state1 = 1 AND p.state2 = 2 THEN 1901 WHEN p.state1 = 3 AND p.state2 = 4 THEN NULL
      ELSE coalesce(h, u) END AS built FROM (SELECT DISTINCT state1, state2 FROM kinds WHERE n >= 3) p LEFT JOIN y USING (state1, state2)""",
)
def best_source_year(t):
    kinds = B.kinds(t)
    strong = kinds.where(F.col("n") >= 3)
    patches = [{"state1": 1, "state2": 2, "built": 1901}, {"state1": 3, "state2": 4, "built": None}]
    barriers = P.union_sources(barrier_sources(t, kinds))
    return P.best_source_year(strong.select("state1", "state2").distinct(), barriers, ["low", "urgent", "high"], patches)


@query(
    "timeline_cumulative",
    """WITH y AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1)
    SELECT year, n, CAST(q AS DOUBLE) AS length, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cum_n, CAST(sum(q) OVER (ORDER BY year) AS DOUBLE)
      AS cum_length FROM y""",
)
def timeline_cumulative(t):
    line = P.timeline(t.lineitem.withColumn("year", F.year("l_shipdate")), "year", N.money("l_quantity"))
    return line.withColumns({c: F.col(c).cast("double") for c in ("length", "cum_length")})


COUNTRY_YEAR_SQL = """
o AS (SELECT c_nationkey AS state, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, o_orderstatus AS s,
    o_orderpriority AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON c_custkey = o_custkey),
app AS (SELECT state, year, count(*) AS applicants, count(*) AS total, nullif(count(*) FILTER (s = 'F'), 0) AS positive,
    nullif(count(*) FILTER (s = 'P'), 0) AS rejected, count(*) FILTER (p = '1-URGENT') AS lawsuits, count(*) FILTER (p = '5-LOW' AND s = 'P') AS checks
  FROM o GROUP BY ALL),
el AS (SELECT state, year AS y0, CASE WHEN month > 6 THEN 9 ELSE 3 END AS half, CASE WHEN month > 6 THEN year + 1 ELSE year END AS year,
    CASE WHEN count(*) FILTER (v > 480000) > 0 THEN coalesce(sum(v) FILTER (v > 480000 AND p > '3'), 0) END AS right_share FROM o GROUP BY ALL),
ek AS (SELECT state, year, right_share FROM el QUALIFY row_number() OVER (PARTITION BY state, year ORDER BY y0 DESC, half DESC) = 1),
k AS (SELECT state, year FROM app UNION SELECT state, year FROM ek),
carried AS (SELECT k.state, k.year, last_value(right_share IGNORE NULLS) OVER (PARTITION BY k.state ORDER BY k.year ROWS UNBOUNDED PRECEDING)
  AS right_share FROM k LEFT JOIN ek ON ek.state = k.state AND ek.year = k.year),
pop AS (SELECT c_nationkey AS state, count(*) AS pop FROM customer GROUP BY 1),
panel AS (SELECT a.state, a.year, applicants, round((total - positive) * 100.0 / total, 4) AS rejection_rate,
    round((total - rejected) * 100.0 / total, 4) AS recognition_rate, round_even(applicants / (pop / 1000), 2) AS per1000, lawsuits, checks,
    CAST(right_share AS DOUBLE) AS right_share
  FROM app a LEFT JOIN pop ON pop.state = a.state LEFT JOIN carried c ON c.state = a.state AND c.year = a.year)"""


def country_years(t):
    """The country-year panel on orders: applications, decisions by status, all orders as votes.

    Only large orders have a known share, so half-years without one are gaps to be filled.
    """
    value = N.money("o_totalprice")
    o = stored(  # one pass over the orders; at most countries x months x labels rows
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(
            F.col("c_nationkey").alias("state"),
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
            F.col("o_orderstatus").alias("s"),
            F.col("o_orderpriority").alias("p"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(value > 480000, value)).alias("large"))
    )
    keys = ["state", "year"]

    def total(df, name="n"):
        return df.groupBy(*keys).agg(F.sum("n").alias(name))

    kind = F.explode(F.array(F.lit("total"), F.when(F.col("s") == "F", "positive").when(F.col("s") == "P", "rejected")))
    decisions = o.select(*keys, kind.alias("decision"), "n").dropna().groupBy(*keys, "decision").agg(F.sum("n").alias("value"))
    day = F.make_date("year", F.when(F.col("month") > 6, 9).otherwise(3), F.lit(1))
    elections = o.select("state", day.alias("day"), F.col("large").alias("share"), F.col("p").alias("position"))
    return P.country_year_panel(
        total(o, "applicants"),
        P.decision_rates(decisions, keys, "total", "positive", "rejected"),
        B.info(t).select("state", "pop"),
        total(o.where(F.col("p") == "1-URGENT")),
        P.party_share(elections, "3"),
        total(o.where((F.col("p") == "5-LOW") & (F.col("s") == "P"))),
    )


@query("country_year_panel", "WITH " + COUNTRY_YEAR_SQL + " SELECT * FROM panel")
def country_year_panel(t):
    rates = {c: F.round(c, 4) for c in ("rejection_rate", "recognition_rate")}
    panel = country_years(t).withColumns(rates).withColumn("right_share", F.col("right_share").cast("double"))
    return panel.select("state", "year", "applicants", *rates, "per1000", "lawsuits", "checks", "right_share")


GROUP_CASE = """CASE WHEN n_regionkey IN (0, 1) AND per1000 > 1300 THEN 'Host' WHEN state IN (2, 7, 12) THEN 'Front' ELSE 'Other' END"""


@query(
    "group_baseyear",
    "WITH " + COUNTRY_YEAR_SQL + f""", g AS (SELECT state, {GROUP_CASE} AS "group" FROM panel JOIN nation ON n_nationkey = state WHERE year = 1996)
    SELECT p.state, year, per1000, "group" FROM panel p LEFT JOIN g ON g.state = p.state""",
)
def group_baseyear(t):
    panel = country_years(t).join(t.nation, F.col("n_nationkey") == F.col("state")).select("state", "year", "per1000", "n_regionkey")
    rule = (
        F.when(F.col("n_regionkey").isin(0, 1) & (F.col("per1000") > 1300), "Host")
        .when(F.col("state").isin(2, 7, 12), "Front")
        .otherwise("Other")
    )
    return P.base_group(panel, "state", "year", 1996, rule).drop("n_regionkey")


@query(
    "group_linear_fit",
    """WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      count(*) AS n, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
      regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1),
    p AS (SELECT l_returnflag, l_quantity, a + b * l_quantity AS fit, sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n
      + (l_quantity - mx) * (l_quantity - mx) / sxx)) AS se, n - 2 AS df, 1.959963984540054 AS z
      FROM (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem) JOIN f USING (l_returnflag)),
    q AS (SELECT *, z + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / df**2
      + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / df**3 AS t FROM p)
    SELECT l_returnflag, l_quantity, round(fit, 3) AS fit, round(se, 3) AS se, round(fit - t * se, 3) AS low, round(fit + t * se, 3) AS high FROM q""",
)
def group_linear_fit(t):
    fit = P.linear_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.withColumns({c: F.round(c, 3) for c in ("fit", "se", "low", "high")})


T_SQL = "CASE n - 2 " + " ".join(
    f"WHEN {n} THEN {t}"
    for n, t in enumerate(
        # closed forms, then fixed values: 0.975 quantiles of Student's t for 3, 4, ... degrees of freedom
        ["1 / tan(pi() * 0.025)", "0.95 / sqrt(2 * 0.975 * 0.025)", 3.18244630528371, 2.77644510519779, 2.57058183563631, 2.44691185114497,
         2.36462425159278, 2.30600413520417, 2.2621571627982, 2.22813885198627, 2.20098516009164, 2.17881282966723, 2.16036865646279,
         2.1447866879178, 2.13144954555978],
        1,
    )
) + " END"


@query(
    "group_linear_small",
    f"""WITH f AS (SELECT l_orderkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      count(*) AS n, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
      regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, l_quantity, CASE WHEN sxx > 0 THEN a + b * l_quantity END AS fit, CASE WHEN sxx > 0 AND n > 2 THEN
      sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) * (1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx)) END AS se, {T_SQL} AS t
      FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem) JOIN f USING (l_orderkey))
    SELECT l_orderkey, l_quantity, round(fit + 0.00137, 2) AS fit, round(se + 0.00137, 2) AS se, round(fit - t * se + 0.00137, 2) AS low, round(fit + t * se + 0.00137, 2) AS high FROM p""",
)
def group_linear_small(t):
    # the small shift keeps exact halves, which two engines may round apart, off the border
    fit = P.linear_fit(t.lineitem, ["l_orderkey"], "l_quantity", "l_extendedprice")
    return fit.withColumns({c: F.round(F.col(c) + 0.00137, 2) for c in ("fit", "se", "low", "high")})


@query(
    "route_flows",
    """WITH m AS (SELECT r_name AS r, c_mktsegment AS s, year(o_orderdate) AS y, month(o_orderdate) AS mon, count(*) AS n FROM orders
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
    SELECT CASE r WHEN 'ASIA' THEN 'Asia route' WHEN 'EUROPE' THEN 'Europe route' ELSE 'Remaining routes' END AS route, CAST(y AS INT) AS year,
      CAST(sum(n) AS BIGINT) AS crossings FROM m GROUP BY ALL""",
)
def route_flows(t):
    located = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    month = F.datediff(F.trunc("o_orderdate", "month"), F.lit("1899-12-30").cast("date")).cast("string")
    counts = stored(A.count_by(located.withColumn("month", month), "r_name", "c_mktsegment", "month"))
    months = sorted(r.month for r in counts.select("month").distinct().dropna().collect())  # calendar months of the data
    wide = counts.groupBy("r_name", "c_mktsegment").pivot("month", months).agg(F.first("n")).fillna(0)
    routes = P.route_flows(wide, ["r_name", "c_mktsegment"], "r_name", months, {"ASIA": "Asia route", "EUROPE": "Europe route"}, "Remaining routes")
    return routes.where(F.col("crossings") > 0)


@query(
    "wide_merge_long",
    """WITH n AS (SELECT o_orderpriority || ' route' AS routes, CAST(year(o_orderdate) AS INT) AS year, count(*) * 1000 AS crossings FROM orders GROUP BY ALL)
    SELECT routes, year, CAST(crossings AS DOUBLE) AS crossings FROM n""",
)
def wide_merge_long(t):
    counts = stored(A.count_by(t.orders.withColumn("year", F.year("o_orderdate")), "o_orderpriority", "year"))
    name = F.concat("o_orderpriority", F.lit(" route (all)")).alias("routes")

    def report(years):
        wide = counts.groupBy(name).pivot("year", years).agg(F.first("n"))
        return wide.select("routes", *[F.replace(F.format_number(F.col(str(y)) * 1000, 0), F.lit(","), F.lit(" ")).alias(str(y)) for y in years])

    years = sorted(r.year for r in counts.select("year").distinct().collect())  # calendar years of the data
    return P.merge_reports([report(years[k : k + 3]) for k in range(0, len(years), 3)], "routes", "crossings")


@query(
    "boundary_attr_join",
    "WITH " + SOURCES_SQL + """, lines AS (SELECT a.n_nationkey AS left_id, b.n_nationkey AS right_id FROM nation a JOIN nation b
      ON b.n_nationkey = a.n_nationkey + 1)
    SELECT left_id, right_id, year, indicator, source FROM lines JOIN barriers ON state1 = left_id AND state2 = right_id WHERE year IS NOT NULL""",
)
def boundary_attr_join(t):
    from dyadspark.operators.geometry import fenced_lines

    right = t.nation.select(F.col("n_nationkey").alias("right_id"), (F.col("n_nationkey") - 1).alias("left_id"))
    lines = right.join(t.nation.select(F.col("n_nationkey").alias("left_id")), "left_id")
    return fenced_lines(lines, P.union_sources(barrier_sources(t))).select("left_id", "right_id", "year", "indicator", "source")


@query(
    "region_subset",
    "WITH " + B.DYADS_SQL + """, f AS (SELECT state1, state2, min(year) AS first_year FROM ship GROUP BY ALL)
    SELECT f.state1, f.state2, first_year, typology, a.region AS region1, b.region AS region2 FROM f JOIN info a ON a.state = f.state1
      JOIN info b ON b.state = f.state2 LEFT JOIN dyads d ON d.state1 = f.state1 AND d.state2 = f.state2 WHERE a.region = 0 OR b.region = 0""",
)
def region_subset(t):
    kinds = B.kinds(t)
    pairs = D.add_both_ends(kinds.select("state1", "state2", "year").distinct(), t.nation, "n_nationkey", {"n_regionkey": "region"})
    one = D.region_subset(pairs, B.dyads(t, kinds), [0], [F.asc("year")])
    return one.select("state1", "state2", F.col("year").alias("first_year"), "typology", "region1", "region2")


@query(
    "settled_pairs",
    "WITH " + B.SHIPMENTS_SQL + """, c AS (SELECT CASE WHEN state1 = 7 THEN 'OVER_7' ELSE a.n_name END AS s1, CASE WHEN state2 = 7 THEN 'OVER_7' ELSE b.n_name
      END AS s2, state1 * 100 + state2 AS dyad, o_orderkey, typology FROM ship LEFT JOIN nation a ON a.n_nationkey = state1 AND a.n_regionkey <> 4
      LEFT JOIN nation b ON b.n_nationkey = state2 AND b.n_regionkey <> 4 WHERE state1 < state2),
    last AS (SELECT * FROM c WHERE s1 IS NOT NULL AND s2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dyad ORDER BY o_orderkey DESC) = 1)
    SELECT s1 AS state1, s2 AS state2, typology AS settle FROM last UNION ALL SELECT s2, s1, typology FROM last""",
)
def settled_pairs(t):
    ship = B.shipments(t).where(F.col("state1") < F.col("state2"))
    walk = t.nation.where(F.col("n_regionkey") != 4)
    coded = ship.select((F.col("state1") * 100 + F.col("state2")).alias("dyad"), "state1", "state2", "o_orderkey", F.col("typology").alias("settle"))
    for end in ("state1", "state2"):
        coded = K.recode(coded, end, walk, "n_nationkey", "n_name", "_name", {7: "OVER_7"}).drop(end).withColumnRenamed("_name", end)
    # rows of one order agree in every column used
    settled = D.settled_pairs(coded, ["dyad"], [F.desc("o_orderkey")])
    return settled.select("state1", "state2", "settle")


@query(
    "capacity_list",
    """SELECT 'Supplier, Greece' AS place, CAST(s_suppkey * 1000 AS DOUBLE) AS capacity FROM supplier
      UNION ALL SELECT c_name || ', Italy', CAST(c_custkey AS DOUBLE) FROM customer""",
)
def capacity_list(t):
    texts = t.supplier.select("s_name", F.replace(F.format_number(F.col("s_suppkey") * 1000, 0), F.lit(","), F.lit(" ")).alias("capacity"))
    return P.capacity_list(texts.withColumnRenamed("s_name", "place"), t.customer.selectExpr("c_name AS place", "c_custkey AS capacity"), "Greece", "Italy")
