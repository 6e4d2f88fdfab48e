"""Borders of polygons that do not share their corner points."""

import math
import random

import pytest

from dyadspark.operators import geometry as G

SCHEMA = "id STRING, ring ARRAY<STRUCT<lon DOUBLE, lat DOUBLE>>"


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * G.EARTH_KM * math.asin(math.sqrt(h))


def borders(spark, polygons, pairs):
    df = spark.createDataFrame(list(polygons.items()), SCHEMA)
    got = G.shared_boundary(df, spark.createDataFrame(pairs, "state1 STRING, state2 STRING")).collect()
    return {(r.state1, r.state2): (r.n_pieces, r.km) for r in got}


def test_junction_in_the_middle_of_a_line(spark):
    """Two small squares on the long side of a third polygon, and one that touches in a single point."""
    polygons = {
        "long": [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0)],
        "left": [(0.0, 1.0), (1.5, 1.0), (1.5, 2.0), (0.0, 2.0)],
        "right": [(1.5, 1.0), (3.0, 1.0), (3.0, 2.0), (1.5, 2.0)],
        "point": [(4.0, 1.0), (5.0, 1.5), (5.0, 2.0)],
    }
    got = borders(spark, polygons, [("long", "left"), ("right", "long"), ("left", "right"), ("long", "point")])
    assert set(got) == {("long", "left"), ("right", "long"), ("left", "right")}
    assert got["long", "left"] == (1, pytest.approx(km((0, 1), (1.5, 1)), rel=1e-9))
    assert got["right", "long"] == (1, pytest.approx(km((1.5, 1), (3, 1)), rel=1e-9))


def test_half_shared_slanted_line(spark):
    """Overlap of two slanted lines of which neither holds the other; corners are off the line by less than the tolerance."""
    at = lambda t: (1 + 3 * t + random.Random(t).uniform(-2e-8, 2e-8), 2 + 1.7 * t)
    polygons = {"a": [at(0.0), at(0.6), (3.0, 0.0)], "b": [at(0.25), at(1.0), (0.0, 9.0)], "far": [(50.0, 1.0), (51.0, 1.0), (50.0, 2.0)]}
    got = borders(spark, polygons, [("a", "b"), ("b", "far")])
    assert list(got) == [("a", "b")] and got["a", "b"] == (1, pytest.approx(km(at(0.25), at(0.6)), rel=1e-6))


def test_random_stairs_by_intervals(spark):
    """Polygons above and below one line, cut at random places: every pair shares the overlap of its two stretches."""
    rng = random.Random(3)
    cuts = lambda: [0.0, *sorted(rng.sample([k / 64 for k in range(1, 640)], 12)), 10.0]
    up, down = cuts(), cuts()
    polygons = {f"u{i}": [(a, 1.0), (b, 1.0), (b, 2.0), (a, 2.0)] for i, (a, b) in enumerate(zip(up, up[1:]))}
    polygons |= {f"d{i}": [(a, 1.0), (a, 0.5), (b, 0.5), (b, 1.0), (a, 1.0)] for i, (a, b) in enumerate(zip(down, down[1:]))}
    pairs = [(f"u{i}", f"d{j}") for i in range(13) for j in range(13)]
    got = borders(spark, polygons, pairs)
    want = {}
    for i in range(13):
        for j in range(13):
            lo, hi = max(up[i], down[j]), min(up[i + 1], down[j + 1])
            if lo < hi:
                want[f"u{i}", f"d{j}"] = km((lo, 1.0), (hi, 1.0))
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want)
    lines = G.interior_lines(spark.createDataFrame(list(polygons.items()), SCHEMA))
    assert sum(r.km for r in lines.collect() if r.p.lat == r.q.lat) == pytest.approx(sum(want.values()))


def test_no_polygons(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert G.interior_lines(none).count() == 0
    assert G.shared_boundary(none, spark.createDataFrame([("a", "b")], "state1 STRING, state2 STRING")).count() == 0
