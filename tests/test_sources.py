from pyspark.sql import functions as F

from dyadspark.operators import columns as C
from dyadspark.operators import profiles as P
from dyadspark.sources import files, sinks

# Invented rows that show the notation: decimal comma, sum, doubled quote, slash, empty tail.
WALLS = '''Land A;Land B;From;Km;Kind;Said by;;;
XAA;XBB;;12,25;Ditch;Daily Page;;;
XCC;XDD;;7+41;;Daily Page;;;
XEE;XFF;2003;5+6;"""Smart hedge""";Weekly Note;;;
XGG;/;;;;Daily Page;;;
'''


def test_semicolon_walls(spark, tmp_path, rows):
    (tmp_path / "w.csv").write_text(WALLS)
    df = files.read_semicolon_walls(spark, str(tmp_path / "w.csv"))
    assert rows(df) == [
        ("XAA", "XBB", None, 12.25, "Ditch", "Daily Page"),
        ("XCC", "XDD", None, 48.0, None, "Daily Page"),
        ("XEE", "XFF", 2003, 11.0, '"Smart hedge"', "Weekly Note"),
        ("XGG", None, None, None, None, "Daily Page"),
    ]


def test_preamble_lines(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text('note\n\nname,v\n"a, b",1\nnote,2\nx,\n')
    df = files.read_table(spark, str(tmp_path / "t.csv"), "name STRING, v INT", skip_lines=2)
    assert rows(df) == [("a, b", 1), ("note", 2), ("x", None)]


def test_profiles_by_region_name(spark, tmp_path, rows):
    for region, code in (("north-america", "us"), ("europe", "gi"), ("meta", "xx")):
        (tmp_path / region).mkdir()
        (tmp_path / region / f"{code}.json").write_text('{"Geography": {"Land boundaries": {"border countries": {"text": "Spain 1.2 km"}}}}')
    (tmp_path / "README.md").write_text("text")
    docs = files.read_profiles(spark, str(tmp_path), ["north-america", "europe"])
    assert rows(docs.select("region", "code", P.path_text("doc", *P.NEIGHBOUR_PATH))) == [("europe", "gi", "Spain 1.2 km"), ("north-america", "us", "Spain 1.2 km")]
    assert P.where_path(docs, "doc", [*P.NEIGHBOUR_PATH, "text"], "Portugal").count() == 0


def test_export_and_imputed_layout(spark, tmp_path, rows):
    df = spark.createDataFrame([(0, 1, None), (1, 1, 2.0)], "imp_no INT, row_id INT, v DOUBLE")
    sinks.export_imputations(df, str(tmp_path / "imp"))
    assert sorted(p.name for p in (tmp_path / "imp").glob("_mj=*")) == ["_mj=0", "_mj=1"]
    back = sinks.load_table(spark, str(tmp_path / "imp"))
    assert rows(back.select("_mj", "_mi", "v")) == [(0, 1, None), (1, 1, 2.0)]
    sinks.export_csv(df, str(tmp_path / "csv"), quote_all=True)
    assert '"imp_no","row_id","v"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


def test_column_helpers(spark):
    df = spark.createDataFrame([("k", None, 1), (None, None, None)], "Col STRING, nothing STRING, n INT")
    assert C.remove_empty(df).columns == ["Col", "n"] and C.remove_empty(df).count() == 1
    head = spark.createDataFrame([(0, "First Name", "x"), (1, "a", "b")], "i INT, V1 STRING, V2 STRING")
    assert C.promote_header(head, "i").columns == ["i", "First Name", "x"]
    assert C.relocate(df, ["n"], before="nothing").columns == ["Col", "n", "nothing"]
    hot = C.one_hot(df.select("Col"), "Col", ["k", "no man's land"], "t").where(F.col("Col") == "k").first()
    assert (hot.t_k, hot.t_no_mans_land) == (1, 0)
