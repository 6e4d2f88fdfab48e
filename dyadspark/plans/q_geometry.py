"""Shared boundaries on a grid of square plots, one per part."""

from pyspark.sql import functions as F

from dyadspark.operators import geometry as G
from dyadspark.plans.registry import query

WIDTH = 200

HAV = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"
GRID_SQL = f"""
g AS (SELECT p_partkey AS id, CAST(p_partkey % {WIDTH} AS DOUBLE) / 100 AS x, CAST(p_partkey // {WIDTH} AS DOUBLE) / 100 AS y,
    CAST(p_partkey % {WIDTH} + 1 AS DOUBLE) / 100 AS x1, CAST(p_partkey // {WIDTH} + 1 AS DOUBLE) / 100 AS y1 FROM part),
seg AS (SELECT id, x AS lon1, y AS lat1, x1 AS lon2, y AS lat2 FROM g UNION ALL SELECT id, x, y1, x1, y1 FROM g
  UNION ALL SELECT id, x, y, x, y1 FROM g UNION ALL SELECT id, x1, y, x1, y1 FROM g)"""


def plots(t):
    """Closed unit squares laid out row by row."""
    at = lambda n: n.cast("double") / 100
    i, j = F.pmod("p_partkey", F.lit(WIDTH)), F.floor(F.col("p_partkey") / WIDTH)
    corner = lambda a, b: F.struct(at(i + a).alias("lon"), at(j + b).alias("lat"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return t.part.select(F.col("p_partkey").alias("id"), ring.alias("ring"))


@query(
    "shared_boundary",
    "WITH " + GRID_SQL + f""", pairs AS (SELECT id AS state1, id + 1 AS state2 FROM g UNION ALL SELECT id, id + {WIDTH} FROM g UNION ALL SELECT id, id + 7 FROM g)
    SELECT state1, state2, count(*) AS n_pieces, round(sum({HAV}), 4) AS km FROM pairs JOIN seg a ON a.id = state1
      JOIN (SELECT id, lon1 AS u1, lat1 AS v1, lon2 AS u2, lat2 AS v2 FROM seg) b ON b.id = state2 AND u1 = lon1 AND v1 = lat1 AND u2 = lon2 AND v2 = lat2
      GROUP BY ALL""",
)
def shared_boundary(t):
    other = F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + WIDTH, F.col("p_partkey") + 7))
    pairs = t.part.select(F.col("p_partkey").alias("state1"), other.alias("state2"))
    return G.shared_boundary(plots(t), pairs).withColumn("km", F.round("km", 4))


@query(
    "interior_lines",
    "WITH " + GRID_SQL + f""" SELECT lon1, lat1, lon2, lat2, n_polygons, round({HAV}, 4) AS km FROM (SELECT lon1, lat1, lon2, lat2, count(*) AS n_polygons
      FROM seg GROUP BY ALL HAVING count(*) >= 2)""",
)
def interior_lines(t):
    lines = G.interior_lines(plots(t))
    return lines.select(
        F.col("p.lon").alias("lon1"), F.col("p.lat").alias("lat1"), F.col("q.lon").alias("lon2"), F.col("q.lat").alias("lat2"),
        "n_polygons", F.round("km", 4).alias("km"),
    )


BRICKS_SQL = f"""
b AS (SELECT p_partkey AS id, (p_partkey // {WIDTH}) AS j, (p_partkey % {WIDTH} + 0.5 * ((p_partkey // {WIDTH}) % 2)) / 100 AS x,
    (p_partkey % {WIDTH} + 1 + 0.5 * ((p_partkey // {WIDTH}) % 2)) / 100 AS x1 FROM part),
o AS (SELECT a.id AS state1, c.id AS state2, CAST(greatest(a.x, c.x) AS DOUBLE) AS lon1, CAST(least(a.x1, c.x1) AS DOUBLE) AS lon2, CAST(c.j AS DOUBLE) / 100 AS lat1,
    CAST(c.j AS DOUBLE) / 100 AS lat2 FROM b a JOIN b c ON c.j = a.j + 1 AND c.x < a.x1 AND a.x < c.x1)"""


def bricks(t):
    """Closed rectangles laid like bricks: every second row is shifted by half a brick."""
    i, j = F.pmod("p_partkey", F.lit(WIDTH)), F.floor(F.col("p_partkey") / WIDTH)
    half = F.pmod(j, F.lit(2)) * 5
    corner = lambda a, b: F.struct(((i * 10 + 10 * a + half).cast("double") / 1000).alias("lon"), ((j + b).cast("double") / 100).alias("lat"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return t.part.select(F.col("p_partkey").alias("id"), ring.alias("ring"))


@query(
    "shared_boundary_uneven",
    "WITH " + BRICKS_SQL + f" SELECT state1, state2, CAST(1 AS BIGINT) AS n_pieces, round({HAV}, 4) AS km FROM o",
)
def shared_boundary_uneven(t):
    """Bricks touch those of the next row along half a side, where they have no common corner points."""
    other = F.explode(F.array(*[F.col("p_partkey") + WIDTH + k for k in (-1, 0, 1)]))
    pairs = t.part.select(F.col("p_partkey").alias("state1"), other.alias("state2"))
    return G.shared_boundary(bricks(t), pairs).withColumn("km", F.round("km", 4))


@query(
    "interior_lines_uneven",
    "WITH " + BRICKS_SQL + f""", s AS (SELECT a.x1 AS lon1, a.j / 100 AS lat1, (a.j + 1) / 100 AS lat2 FROM b a JOIN b c ON c.j = a.j AND c.id = a.id + 1)
    SELECT 'level' AS kind, count(*) AS n, round(sum({HAV}), 3) AS km FROM o
    UNION ALL SELECT 'upright', count(*), round(sum({HAV.replace("lon2 - lon1", "0")}), 3) FROM s""",
)
def interior_lines_uneven(t):
    """Lines between bricks by direction."""
    kind = F.when(F.col("p.lon") == F.col("q.lon"), "upright").otherwise("level")
    return G.interior_lines(bricks(t)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("km"), 3).alias("km"))
