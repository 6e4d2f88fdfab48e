import itertools
import random

from pyspark.sql import functions as F

from dyadspark.operators import dyads as D
from dyadspark.operators import geometry as G
from dyadspark.operators import panel as P
from dyadspark.operators import tables as T
from dyadspark.operators.aggregates import add_total_row


def test_key_is_undirected(spark):
    df = spark.createDataFrame([("B", "A"), ("A", "B"), ("A", None)], "a STRING, b STRING")
    assert [r.k for r in df.select(D.dyad_key("a", "b").alias("k")).collect()] == ["A_B", "A_B", None]


def test_mirror_twice_adds_nothing_new(spark, rows):
    df = spark.createDataFrame([("A", "B", 1, 2), ("A", "C", 3, 4)], "state1 STRING, state2 STRING, export INT, import INT")
    swaps = [("state1", "state2"), ("export", "import")]
    once = D.mirror(df, swaps)
    assert ("B", "A", 2, 1) in rows(once) and rows(D.mirror(once, swaps).distinct()) == rows(once.distinct())


def test_shared_groups_small_and_hot(spark, rows):
    members = [("g1", c, 0.5) for c in "ABC"] + [("g2", "A", 1.0), ("g3", "A", 0.6), ("g3", "B", 0.05), ("g4", "B", 0.5), ("g4", "A", 0.5)]
    df = spark.createDataFrame(members, "g STRING, c STRING, share DOUBLE")
    want = [("A", "B", 2), ("A", "C", 1), ("B", "A", 2), ("B", "C", 1), ("C", "A", 1), ("C", "B", 1)]
    assert rows(D.shared_groups(df, "g", "c", "share", 0.1)) == want

    rng = random.Random(3)
    big = [("hot", rng.choice("ABCDEF")) for _ in range(4000)] + [(f"g{rng.randrange(300)}", rng.choice("ABCDEF")) for _ in range(2000)]
    counts = {}
    for g in {g for g, _ in big}:
        for a, b in itertools.combinations(sorted({c for h, c in big if h == g}), 2):
            counts[a, b] = counts.get((a, b), 0) + 1
    got = D.pairs_in_groups(spark.createDataFrame(big, "g STRING, c STRING"), "g", "c")
    assert {(r.state1, r.state2): r.n_shared for r in got.collect()} == counts


def test_trade_shares_sum_to_100(spark):
    flows = [(a, b, 2000, (a + 1) * 10 + b) for a in range(4) for b in range(4)]
    names = spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(4)], "state INT, name STRING, region INT")
    panel = D.trade_panel(spark.createDataFrame(flows, "state1 INT, state2 INT, year INT, flow INT"), names)
    for r in panel.groupBy("state1").agg(F.sum("share_export").alias("e"), F.sum("share_import").alias("i")).collect():
        assert abs(r.e - 100) < 1e-3 and abs(r.i - 100) < 1e-3


def test_relation_status(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (None, 0)], "a INT, b INT")
    got = [r.x for r in df.select(D.relation_status("a", "b", ("no colony", "colonizer", "colonized")).alias("x")).collect()]
    assert got == ["no colony", "colonizer", "colonized", None, None]


def test_pooled_routes_sum_all_routes(spark, rows):
    wide = spark.createDataFrame([("Minor A", 1, 2), ("Minor B", 10, 20), ("Main", 100, 200)], "route STRING, `43101` INT, `43466` INT")
    got = P.route_flows(wide, ["route"], "route", ["43101", "43466"], {"Main": "Main route"}, "Rest")
    assert rows(got) == [("Main route", 2018, 100), ("Main route", 2019, 200), ("Rest", 2018, 11), ("Rest", 2019, 22)]


def test_student_t(spark):
    known = {1: 12.706204736174698, 2: 4.302652729911275, 3: 3.18244630528371, 10: 2.228138851964939, 200: 1.971896224271, 201: 1.971836502741, 1000: 1.962339080792}
    df = spark.createDataFrame([(float(n),) for n in known], "n DOUBLE")
    for r in df.select("n", P.student_t(0.95, F.col("n")).alias("t")).collect():
        assert abs(r.t - known[int(r.n)]) < 1e-7
    assert spark.range(1).select(P.student_t(0.95, F.lit(0)).alias("t")).first().t is None


def test_lines_of_small_groups(spark):
    """One point or one x value: no line; two points: no band; three: the band of one degree of freedom."""
    data = [("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 4.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("d", 1.0, 1.0), ("d", 2.0, 3.0), ("d", 3.0, 2.0), ("e", None, 1.0)]
    got = {(r.g, r.x): r for r in P.linear_fit(spark.createDataFrame(data, "g STRING, x DOUBLE, y DOUBLE"), ["g"], "x", "y").collect()}
    assert got["a", 1.0].fit is None and got["b", 1.0].fit is None and got["b", 1.0].low is None
    assert abs(got["c", 2.0].fit - 4.0) < 1e-9 and got["c", 2.0].se is None and got["c", 2.0].high is None
    d = got["d", 2.0]
    assert abs(d.fit - 2.0) < 1e-9 and abs(d.se - 0.70710678) < 1e-6 and abs(d.high - 2.0 - 12.7062047 * d.se) < 1e-5


def test_party_share_takes_the_last_of_three(spark, rows):
    df = spark.sql("VALUES ('A', DATE'2014-09-01', 3.0, 9), ('A', DATE'2015-01-01', 4.0, 9), ('A', DATE'2015-03-01', 5.0, 9) AS t(state, day, share, position)")
    assert rows(P.party_share(df, 8).select("state", "year", F.col("right_share").cast("double"))) == [("A", 2015, 5.0)]


def test_party_share_takes_the_later_of_two(spark, rows):
    df = spark.sql("VALUES ('A', DATE'2014-09-01', 3.0, 9), ('A', DATE'2015-03-01', 5.0, 9), ('A', DATE'2015-03-01', 50.0, 2), ('B', DATE'2016-01-01', 7.0, 1) AS t(state, day, share, position)")
    got = P.party_share(df, 8).select("state", "year", F.col("right_share").cast("double"))
    assert rows(got) == [("A", 2015, 5.0), ("B", 2016, 0.0)]


def test_total_row_and_distribution(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "region STRING, kind STRING")
    table = T.distribution(df, "region", "kind", ["a", "b"])
    assert rows(table) == [("x", 50.0, 100.0, 75.0), ("y", 50.0, 0.0, 25.0)]
    assert ("Total", 100.0, 100.0, 100.0) in rows(add_total_row(table))


def squares(spark):
    def ring(x, y):
        return [(float(a), float(b)) for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))]

    return spark.createDataFrame([("L", ring(0, 0)), ("R", ring(1, 0)), ("far", ring(5, 5))], "id STRING, ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>")


def test_two_squares_share_one_side(spark):
    pairs = spark.createDataFrame([("L", "R"), ("R", "L"), ("L", "far")], "state1 STRING, state2 STRING")
    got = {(r.state1, r.state2): r for r in G.shared_boundary(squares(spark), pairs).collect()}
    assert set(got) == {("L", "R"), ("R", "L")} and got["L", "R"].n_pieces == 1
    assert abs(got["L", "R"].km - 111.195) < 0.01
    (line,) = G.interior_lines(squares(spark)).collect()
    assert (line.p.lon, line.p.lat, line.q.lon, line.q.lat, line.n_polygons) == (1.0, 0.0, 1.0, 1.0, 2)


def test_best_source_and_patches(spark, rows):
    pairs = spark.createDataFrame([("A", "B"), ("C", "D"), ("E", "F")], "state1 STRING, state2 STRING")
    barriers = spark.createDataFrame(
        [("A", "B", "1999", "w", "s1"), ("A", "B", "2005", "w", "s2"), ("A", "B", "2003", "w", "s2"), ("C", "D", "soon", "w", "s2"), ("C", "D", "1950", "w", "s1")],
        "state1 STRING, state2 STRING, year STRING, indicator STRING, source STRING",
    )
    got = P.best_source_year(pairs, barriers, ["s1", "s2"], [{"state1": "E", "state2": "F", "built": 1901}])
    assert rows(got) == [("A", "B", 2003), ("C", "D", 1950), ("E", "F", 1901)]


def test_pairs_of_large_groups_by_blocks(spark):
    """Groups above the block size, equal and null ones, repeated members and members without a group."""
    rng = random.Random(6)
    members = [(g, m) for g in range(12) for m in rng.sample(range(60), rng.choice([1, 2, 9, 30, 60]))]
    members += [(None, m) for m in range(25)] + members[:20] + [(3, None)] + [(g, m) for g in (20, 21) for m in range(15)]
    want: dict = {}
    for g in {g for g, _ in members}:
        for pair in itertools.combinations(sorted({m for h, m in members if h == g and m is not None}), 2):
            want[pair] = want.get(pair, 0) + 1
    df = spark.createDataFrame(members, "g INT, m INT").repartition(5)
    for block in (4, 10, 1000):
        got = D.pairs_in_groups(df, "g", "m", block).collect()
        assert {(r.state1, r.state2): r.n_shared for r in got} == want and len(got) == len(want)
    hot = spark.range(3000).selectExpr("1 AS g", "id AS m")
    pairs = D.pairs_in_groups(hot, "g", "m", 128)
    assert pairs.agg(F.count("*"), F.min("n_shared"), F.max("n_shared")).first() == (3000 * 2999 // 2, 1, 1)
