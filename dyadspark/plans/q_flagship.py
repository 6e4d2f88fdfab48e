"""Yearly directed trade panel."""

from dyadspark.operators import dyads as D
from dyadspark.plans import base as B
from dyadspark.plans.registry import query

TRADE_SQL = (
    "WITH "
    + B.FLOWS_SQL
    + """,
both_ways AS (SELECT year, least(state1, state2) AS state1, greatest(state1, state2) AS state2,
    max(CASE WHEN state1 < state2 THEN flow END) AS export, max(CASE WHEN state1 > state2 THEN flow END) AS import
  FROM flows WHERE state1 <> state2 GROUP BY ALL),
directed AS (SELECT year, state1, state2, export, import FROM both_ways
  UNION ALL SELECT year, state2, state1, import, export FROM both_ways),
total AS (SELECT year, state1, coalesce(sum(export), 0) AS total_export, coalesce(sum(import), 0) AS total_import
  FROM directed GROUP BY ALL)
SELECT d.year, a.n_name AS state1, b.n_name AS state2,
  concat_ws('_', least(a.n_name, b.n_name), greatest(a.n_name, b.n_name)) AS dyad,
  a.n_regionkey AS region1, b.n_regionkey AS region2,
  CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END AS same_region,
  CAST(export AS DOUBLE) AS export, CAST(import AS DOUBLE) AS import,
  CAST(total_export AS DOUBLE) AS total_export, CAST(total_import AS DOUBLE) AS total_import,
  round(CAST(export AS DOUBLE) / nullif(CAST(total_export AS DOUBLE), 0) * 100, 4) AS share_export,
  round(CAST(import AS DOUBLE) / nullif(CAST(total_import AS DOUBLE), 0) * 100, 4) AS share_import,
  round(ln(1 + CAST(export AS DOUBLE)), 4) AS export_log, round(ln(1 + CAST(import AS DOUBLE)), 4) AS import_log
FROM directed d JOIN total t ON t.year = d.year AND t.state1 = d.state1
JOIN nation a ON a.n_nationkey = d.state1 JOIN nation b ON b.n_nationkey = d.state2"""
)


@query("trade_panel", TRADE_SQL)
def trade_panel(t):
    names = t.nation.selectExpr("n_nationkey AS state", "n_name AS name", "n_regionkey AS region")
    return D.trade_panel(B.flows(t), names)
