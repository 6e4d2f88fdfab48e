"""The panel of neighbouring countries from sources made of the star schema: nations stand for countries, flows for pairs."""

from pyspark.sql import functions as F

from dyadspark.plans import base as B
from dyadspark.plans import border_panel as P
from dyadspark.plans.registry import query
from dyadspark.session import stored

YEARS = P.Years(pairs=1997, trade=1996, regime=2017, religion=2010, incidents=1995, refugees=1997, gravity=1997, terrain=1994, disputes_since=1996)
SEGMENTS = {"chrstcat": "BUILDING", "chrstorth": "AUTOMOBILE", "islmsun": "HOUSEHOLD", "hindgen": "MACHINERY", "budmah": "FURNITURE"}


def sources(t) -> P.Sources:
    """Every source with the columns that the panel needs; one row per pair and year comes from the flows."""
    flows = stored(B.flows(t).where(F.col("state1") != F.col("state2")).withColumn("flow", F.col("flow").cast("double")))
    info = stored(B.info(t))
    names = info.select(F.col("state").alias("k"), "name", F.col("region").alias("r"))
    number = lambda c: (F.col(c) + 1).alias  # noqa: E731 - numbers of countries begin at 1
    named = flows.join(names.select(F.col("k").alias("state1"), F.col("name").alias("name1"), F.col("r").alias("r1")), "state1")
    named = named.join(names.select(F.col("k").alias("state2"), F.col("name").alias("name2"), F.col("r").alias("r2")), "state2")
    ends = [F.col("name1").alias("state1"), F.col("name2").alias("state2")]
    people = t.customer.groupBy((F.col("c_nationkey") + 1).alias("state")).agg(
        *[F.count(F.when(F.col("c_mktsegment") == s, 1)).cast("int").alias(c) for c, s in SEGMENTS.items()]
    )
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(names, F.col("k") == F.col("c_nationkey"))
    return P.Sources(
        contiguity=flows.select(number("state1")("state1no"), number("state2")("state2no"), "year", F.when(F.col("state1") < 20, 1).otherwise(2).alias("conttype")),
        number_codes=names.select(number("k")("number"), F.col("name").alias("code")),
        regime_codes=names.select(F.col("k").cast("string").alias("scode"), F.col("name").alias("code")),
        agreements=named.where("year = 1996").select(*ends, F.col("n").cast("int").alias("settle")),
        indicators=info.select(
            F.col("name").alias("code"), F.col("pop").cast("double").alias("pop"), F.col("wealth").alias("gdp"), F.col("polity").cast("double").alias("military_pers"),
            F.col("army").alias("military_expenditure_perc_gdp"), (F.col("wealth") * 2).alias("gdp_2014"),
        ),
        trade=flows.where("state1 < state2").select(
            number("state1")("ccode1"), number("state2")("ccode2"), "year", F.col("flow").alias("flow1"), F.when(F.col("n") == 1, -9.0).otherwise(F.col("n")).alias("flow2")
        ),
        regimes=info.select(F.col("state").cast("string").alias("scode"), F.lit(2017).alias("year"), F.col("polity").cast("int").alias("polity2")),
        religions=people.withColumn("year", F.lit(2010)),
        disputes=flows.where("n > 1").select(
            number("state1")("statea"), number("state2")("stateb"), "year", (F.col("year") - 1).alias("strtyr"), F.col("n").cast("int").alias("outcome")
        ),
        incidents=orders.select(
            F.col("name").alias("code"), F.year("o_orderdate").alias("iyear"), F.when(F.col("o_orderstatus") == "F", 1.0).alias("nkill"), F.lit(0.0).alias("nwound")
        ),
        refugees=flows.select(number("state1")("asylum_ccode"), number("state2")("origin_ccode"), "year", F.col("n").cast("double").alias("ylinpol")),
        gravity=named.select(
            F.col("name1").alias("iso3_o"), F.col("name2").alias("iso3_d"), "year", (F.col("state1") < F.col("state2")).cast("int").alias("heg_o"), F.lit(0).alias("heg_d"),
            (F.col("n") > 2).cast("int").alias("col_dep_ever"), (F.col("r1") == F.col("r2")).cast("int").alias("comlang_off"), (F.col("n") / 10).alias("comrelig"),
        ),
        neighbours=named.where("year = 1995").select(*ends, (F.col("n") * 1.5).alias("km"), F.concat(F.lit("land "), "r1").alias("terrain")),
        terrain=flows.where("state1 < state2").select(number("state1")("statea"), number("state2")("stateb"), "year", F.col("n").cast("double").alias("rti")),
    )


PANEL_SQL = "WITH " + B.FLOWS_SQL + "," + B.INFO_SQL + """,
f AS (SELECT a.n_name AS s1, b.n_name AS s2, a.n_regionkey AS r1, b.n_regionkey AS r2, state1 AS k1, state2 AS k2, year, CAST(flow AS DOUBLE) AS flow, n
  FROM flows JOIN nation a ON a.n_nationkey = state1 JOIN nation b ON b.n_nationkey = state2 WHERE state1 <> state2),
pairs AS (SELECT s1, s2 FROM f WHERE year = 1997 AND k1 < 20 UNION ALL SELECT 'NGA', 'TCD' UNION ALL SELECT 'TCD', 'NGA'),
und AS (SELECT s1, s2, flow AS i, CASE WHEN n = 1 THEN NULL ELSE CAST(n AS DOUBLE) END AS e FROM f WHERE year = 1996 AND k1 < k2),
tot AS (SELECT s1, sum(i) AS ti, coalesce(sum(e), 0) AS te FROM und GROUP BY 1),
sh AS (SELECT s1, s2, i, e, i / nullif(ti, 0) * 100 AS si, e / nullif(te, 0) * 100 AS se FROM und JOIN tot USING (s1)),
trade AS (SELECT s1, s2, i, e, si, se FROM sh UNION ALL SELECT s2, s1, e, i, se, si FROM sh),
rel AS (SELECT n_name AS s, family AS relig FROM (SELECT c_nationkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'chrst' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'islm'
    WHEN c_mktsegment = 'MACHINERY' THEN 'hindgen' ELSE 'bud' END AS family, count(*) AS people FROM customer GROUP BY ALL)
    JOIN nation ON n_nationkey = c_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY people DESC, family) = 1),
shrt AS (SELECT s, relig, CASE WHEN relig IN ('bud', 'hindgen', 'jud', 'nonrelig', 'syncgen') THEN 'other' ELSE relig END AS short FROM rel),
dis AS (SELECT s1, s2, year AS disp_year, CAST(n AS INT) AS disp_outcome FROM (SELECT * FROM f WHERE n > 1
    QUALIFY row_number() OVER (PARTITION BY s1, s2 ORDER BY year DESC) = 1) WHERE year - 1 >= 1996),
inc AS (SELECT n_name AS s, count(*) AS nterror, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS deaths FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey WHERE year(o_orderdate) = 1995 GROUP BY 1),
ref AS (SELECT s1, s2, CAST(n AS DOUBLE) AS people, CAST(sum(n) OVER (PARTITION BY s1) AS DOUBLE) AS agg FROM f WHERE year = 1997),
land AS (SELECT s1, s2, n * 1.5 AS km FROM f WHERE year = 1995), text AS (SELECT DISTINCT s1, 'land ' || r1 AS terrain FROM f WHERE year = 1995),
rti AS (SELECT s1, s2, CAST(n AS DOUBLE) AS rti FROM f WHERE year = 1994 AND k1 < k2),
ids AS (SELECT *, dense_rank() OVER (ORDER BY least(s1, s2) || '_' || greatest(s1, s2)) AS dyadID FROM pairs)
SELECT p.s1 AS state1, p.s2 AS state2, least(p.s1, p.s2) || '_' || greatest(p.s1, p.s2) AS "dyadName", dyadID AS "dyadID", CAST(ag.n AS INT) AS settle,
  round(a.wealth / nullif(b.wealth, 0), 6) AS ratio_gdp, round(ln(1 + CAST(a.pop AS DOUBLE)), 6) AS state1_pop_log, CAST(b.pop AS DOUBLE) / 1000000 AS state2_pop_in_million,
  round(a.polity / nullif(CAST(a.pop AS DOUBLE), 0) * 1000, 6) AS state1_military_pers_p1000, round(t.i, 2) AS import, round(t.e, 2) AS export, round(t.si, 6) AS share_import,
  round(t.se, 6) AS share_export, round((t.i + t.e) / nullif(a.wealth * 2, 0), 6) AS economic_dependence, CAST(a.polity AS INT) AS state1_polity,
  CAST(a.polity - b.polity AS INT) AS diff_pol, CAST(abs(a.polity - b.polity) AS INT) AS absdiff_pol, x.relig AS state1_relig, y.short AS state2_relig_shrt,
  CASE WHEN x.relig IS NULL OR y.relig IS NULL THEN NULL WHEN x.relig <> y.relig THEN 1 ELSE 0 END AS diff_relig, CASE WHEN y.relig IS NULL THEN NULL WHEN y.relig = 'islm' THEN 1 ELSE 0 END AS state2_muslim,
  CASE WHEN d.s1 IS NULL THEN 0 ELSE 1 END AS disp_from_1996, CAST(d.disp_year AS INT) AS disp_year, d.disp_outcome, coalesce(g.nterror, 0) AS state1_nterror, coalesce(h.deaths, 0) AS state2_death_toll,
  round(ln(1 + coalesce(g.nterror, 0)), 6) AS state1_nterror_log, ri.people AS refugees_incoming, ri.agg AS refugees_incoming_agg, round(ri.people / nullif(CAST(a.pop AS DOUBLE), 0), 6) AS refugees_incoming_pc,
  ro.people AS refugees_outgoing, ro.agg AS refugees_outgoing_agg, CASE WHEN gr.k1 < gr.k2 THEN 1 WHEN gr.k1 IS NOT NULL THEN 0 END AS state1_colonizer,
  CASE WHEN gr.n > 2 THEN 1 WHEN gr.n IS NOT NULL THEN 0 END AS colony, CASE WHEN gr.r1 = gr.r2 THEN 1 WHEN gr.n IS NOT NULL THEN 0 END AS comlang_off, CAST(gr.n AS DOUBLE) / 10 AS relig_prox,
  CASE WHEN gr.k1 < gr.k2 THEN 'colonizer' WHEN gr.n IS NOT NULL THEN 'no colony' END AS colonial_status, CAST(l.km AS DOUBLE) AS blength, w.terrain, rr.rti
FROM ids p LEFT JOIN (SELECT * FROM f WHERE year = 1996) ag ON ag.s1 = p.s1 AND ag.s2 = p.s2 LEFT JOIN info a ON a.name = p.s1 LEFT JOIN info b ON b.name = p.s2
  LEFT JOIN trade t ON t.s1 = p.s1 AND t.s2 = p.s2 LEFT JOIN shrt x ON x.s = p.s1 LEFT JOIN shrt y ON y.s = p.s2 LEFT JOIN dis d ON d.s1 = p.s1 AND d.s2 = p.s2
  LEFT JOIN inc g ON g.s = p.s1 LEFT JOIN inc h ON h.s = p.s2 LEFT JOIN ref ri ON ri.s1 = p.s1 AND ri.s2 = p.s2 LEFT JOIN ref ro ON ro.s1 = p.s2 AND ro.s2 = p.s1
  LEFT JOIN (SELECT * FROM f WHERE year = 1997) gr ON gr.s1 = p.s1 AND gr.s2 = p.s2 LEFT JOIN land l ON l.s1 = p.s1 AND l.s2 = p.s2 LEFT JOIN text w ON w.s1 = p.s1
  LEFT JOIN rti rr ON least(rr.s1, rr.s2) = least(p.s1, p.s2) AND greatest(rr.s1, rr.s2) = greatest(p.s1, p.s2)"""

DIGITS = {
    "ratio_gdp": 6, "state1_pop_log": 6, "state1_military_pers_p1000": 6, "import": 2, "export": 2, "share_import": 6, "share_export": 6, "economic_dependence": 6,
    "state1_nterror_log": 6, "refugees_incoming_pc": 6,
}
EXACT = """state1 state2 dyadName dyadID settle state2_pop_in_million state1_polity diff_pol absdiff_pol state1_relig state2_relig_shrt diff_relig state2_muslim disp_from_1996
  disp_year disp_outcome state1_nterror state2_death_toll refugees_incoming refugees_incoming_agg refugees_outgoing refugees_outgoing_agg state1_colonizer colony comlang_off
  relig_prox colonial_status blength terrain rti""".split()


@query("border_panel", PANEL_SQL)
def border_panel(t):
    """All pairs with the attributes of every source."""
    panel = P.border_panel(sources(t), YEARS)
    return panel.select(*EXACT, *[F.round(c, n).alias(c) for c, n in DIGITS.items()])
