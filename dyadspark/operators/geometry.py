"""Boundaries shared by polygons, found with equi-joins on line pieces.

Polygons are (id, ring) with ``ring ARRAY<STRUCT<lon DOUBLE, lat DOUBLE>>``, closed or not. Polygons need not share their
corner points: lines are cut first wherever a corner of any polygon lies on them (see ``noded``), so a border that
begins or ends in the middle of a neighbour's line counts for just the part in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.session import stored

EARTH_KM = 6371.0088


def km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def segments(polygons: DataFrame, key: str = "id", ring: str = "ring") -> DataFrame:
    """Distinct undirected line pieces (key, p, q, km) of each polygon, without a window or shuffle per ring."""
    points = F.col(ring)
    rotated = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    pieces = polygons.select(key, F.explode(F.arrays_zip(points.alias("a"), rotated.alias("b"))).alias("_s"))
    ends = pieces.select(key, F.least("_s.a", "_s.b").alias("p"), F.greatest("_s.a", "_s.b").alias("q"))
    return ends.where(F.col("p") != F.col("q")).distinct()


TOLERANCE = 1e-7  # degrees; about a centimetre


def noded(pieces: DataFrame, key: str = "id", tolerance: float = TOLERANCE) -> DataFrame:
    """The same lines, cut at every corner (of any polygon) that lies within ``tolerance`` degrees of them.

    Corners and lines meet by the cells of a grid as wide as an average line; a line is put into the cells it passes,
    column by column, so a long one costs its length and not its frame. A corner nearer than the tolerance to an end of
    the line does not cut it. The parts keep the corners' own coordinates, so parts of two polygons are equal.
    """
    dx, dy = F.col("q.lon") - F.col("p.lon"), F.col("q.lat") - F.col("p.lat")
    mean = pieces.agg(F.avg(F.greatest(F.abs(dx), F.abs(dy)))).first()[0]
    if mean is None:
        return pieces
    cell = max(mean, 10 * tolerance)
    corners = pieces.select(F.explode(F.array("p", "q")).alias("v")).distinct()
    corners = corners.select("v", F.floor(F.col("v.lon") / cell).alias("_i"), F.floor(F.col("v.lat") / cell).alias("_j"))
    # p is the end with the lesser longitude; the line's latitudes within a column lie between those at the column's edges
    first, last = F.col("p.lon") - tolerance, F.col("q.lon") + tolerance
    columns = pieces.withColumn("_i", F.explode(F.sequence(F.floor(first / cell), F.floor(last / cell))))
    upright = F.abs(dx) <= tolerance

    def at(lon: Column) -> Column:
        inside = F.least(F.greatest(lon, F.col("p.lon")), F.col("q.lon"))
        return F.col("p.lat") + (inside - F.col("p.lon")) / dx * dy

    left, right = at(F.col("_i") * cell - tolerance), at((F.col("_i") + 1) * cell + tolerance)
    low = F.when(upright, F.least("p.lat", "q.lat")).otherwise(F.least(left, right)) - tolerance
    high = F.when(upright, F.greatest("p.lat", "q.lat")).otherwise(F.greatest(left, right)) + tolerance
    cells = columns.withColumn("_j", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    px, py = F.col("v.lon") - F.col("p.lon"), F.col("v.lat") - F.col("p.lat")
    size = F.sqrt(dx * dx + dy * dy)
    along, across = (px * dx + py * dy) / size, F.abs(px * dy - py * dx) / size
    on = (across <= tolerance) & (along > tolerance) & (along < size - tolerance)
    cuts = cells.join(corners, ["_i", "_j"]).where(on).groupBy(key, "p", "q").agg(F.collect_set(F.struct(along.alias("t"), "v")).alias("_cuts"))
    whole = pieces.alias("a").join(cuts.alias("b"), [key, "p", "q"], "left")
    inner = F.transform(F.array_sort(F.coalesce("_cuts", F.array())), lambda c: c["v"])
    points = F.concat(F.array("p"), inner, F.array("q"))
    parts = whole.select(key, points.alias("_points")).select(
        key, F.explode(F.arrays_zip(F.slice("_points", F.lit(1), F.size("_points") - 1).alias("a"), F.slice("_points", F.lit(2), F.size("_points") - 1).alias("b"))).alias("_s")
    )
    return parts.select(key, F.least("_s.a", "_s.b").alias("p"), F.greatest("_s.a", "_s.b").alias("q")).distinct()


def length_km() -> Column:
    return km(F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat"))


def shared_boundary(polygons: DataFrame, pairs: DataFrame, key: str = "id", tolerance: float = TOLERANCE) -> DataFrame:
    """Pieces and length common to the two polygons of each listed pair (state1, state2).

    The pair list drives the joins, so the pieces of a pair meet on (pair, piece) and nothing else is formed.
    """
    pieces = stored(noded(stored(segments(polygons, key)), key, tolerance))
    left = pairs.select("state1", "state2").join(pieces.withColumnRenamed(key, "state1"), "state1")
    both = left.join(pieces.withColumnRenamed(key, "state2"), ["state2", "p", "q"], "left_semi")
    return both.groupBy("state1", "state2").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(length_km()).alias("km"))


def interior_lines(polygons: DataFrame, key: str = "id", tolerance: float = TOLERANCE) -> DataFrame:
    """Line pieces that belong to more than one polygon."""
    used = noded(stored(segments(polygons, key)), key, tolerance).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n_polygons"))
    return used.where(F.col("n_polygons") >= 2).withColumn("km", length_km())


def fenced_lines(lines: DataFrame, barriers: DataFrame) -> DataFrame:
    """Lines with a left and right country that carry a dated barrier (barriers hold both directions)."""
    joined = lines.join(
        barriers, (F.col("left_id") == F.col("state1")) & (F.col("right_id") == F.col("state2")), "left"
    )
    return joined.where(F.col("indicator").isNotNull() & F.col("year").isNotNull()).drop("state1", "state2")
