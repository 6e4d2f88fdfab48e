from datetime import date

from pyspark.sql import functions as F

from dyadspark.functions import dates as Y
from dyadspark.functions import text as X
from dyadspark.functions.html import _anchors, _cells, html_links, html_tables
from dyadspark.operators import codes as K
from dyadspark.operators import profiles as P
from dyadspark.operators.columns import clean_name


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_neighbour_text(spark):
    def parse(text):
        return [(e.neighbour, e.km) for e in one(spark, X.neighbour_lengths(F.lit(text)))]

    assert parse("Algeria 41 km, Mauritania 1,564 km, Morocco 444 km") == [("Algeria", 41.0), ("Mauritania", 1564.0), ("Morocco", 444.0)]
    assert parse("Spain 1.2 km") == [("Spain", 1.2)]
    assert parse("Saint Martin (France) 16 km") == [("Saint Martin (France)", 16.0)]
    assert parse("China (central) 7,000,250.5 km") == [("China (central)", 7000250.5)]
    assert parse("none") == []


def test_country_without_border_stays(spark, rows):
    df = spark.createDataFrame([("a", "B 3 km"), ("c", None)], "k STRING, t STRING")
    assert rows(P.neighbour_rows(df, "t", ["k"])) == [("a", "B", 3.0), ("c", None, None)]


def test_neighbour_lengths_sums_pieces(spark, rows):
    docs = spark.createDataFrame(
        [("aa", '{"Geography": {"Land boundaries": {"border countries": {"text": "Bee 3 km, Bee (north) 1,002.5 km"}}}}'), ("bb", '{"Geography": {"Terrain": {"text": "flat"}}}')],
        "code STRING, j STRING",
    ).select("code", F.parse_json("j").alias("doc"))
    walk = spark.createDataFrame([("aa", "AAA"), ("bb", "BBB")], "code STRING, id STRING")
    got = P.neighbour_lengths(docs, walk, [("bee", "BBB")])
    assert rows(got.select("state1", "state2", "km", "terrain")) == [("AAA", "BBB", 1005.5, None), ("BBB", None, None, "flat")]
    got = P.neighbour_lengths(docs, walk, [("bee", "BBB")], unnamed={"BBB": "CCC"})
    assert rows(got.select("state1", "state2", "km")) == [("AAA", "BBB", 1005.5), ("BBB", "CCC", None)]


def test_lengths_and_numbers(spark):
    assert one(spark, X.additive_length(F.lit("33+130"))) == 163 and one(spark, X.additive_length(F.lit("10+10"))) == 20
    assert one(spark, X.additive_length(F.lit("3,7"))) == 3.7 and one(spark, X.additive_length(F.lit("/"))) is None
    assert one(spark, X.number(F.lit("1 234,567"))) == 1234567 and one(spark, X.number(F.lit("n/a"))) is None
    assert one(spark, X.quantity(F.lit("98.5 billion bbl (1 January 2016 es)"))) == 98.5e9
    assert one(spark, X.quantity(F.lit("1,200 bbl/day"))) == 1200 and one(spark, X.quantity(F.lit("none"))) is None


def test_names_and_marks(spark):
    a, b = X.two_names(F.lit("Saudi Arabia - Yemen"))
    assert (one(spark, a), one(spark, b)) == ("Saudi Arabia", "Yemen")
    assert one(spark, X.unbracket(F.lit("Western route (sea) x"))) == "Western route x"
    assert one(spark, X.squish(F.lit("  a \n\t b "))) == "a b"
    assert one(spark, X.replace_first(F.lit("a.b.c"), "[.]", "-")) == "a-b.c"
    assert one(spark, X.drop_end(F.lit("abc_"))) == "abc" and one(spark, X.drop_end(F.lit(""))) == ""
    assert [one(spark, X.stars(F.lit(p))) for p in (0.0001, 0.005, 0.03, 0.07, 0.5)] == ["***", "**", "*", ".", ""]
    assert one(spark, X.number_text(F.lit(0.1))) == "0.1" and one(spark, X.number_text(F.lit(-12.0))) == "-12"
    assert clean_name("Member State (%)") == "member_state_percent" and clean_name("NoOfSeats") == "no_of_seats"


def test_dictionary_order_and_overrides(spark, rows):
    df = spark.createDataFrame([("Republic of Niger",), ("Nigeria",), ("Kosovo",), (None,), ("Atlantis",)], "n STRING")
    words = [(r"\bniger\b", "NER"), ("nigeria", "NGA"), ("niger", "XXX")]
    got = K.recode_name(df, "n", words, "code", {"Kosovo": "XKX"})
    assert rows(got) == [(None, None), ("Atlantis", None), ("Kosovo", "XKX"), ("Nigeria", "NGA"), ("Republic of Niger", "NER")]


def test_dates(spark):
    assert one(spark, Y.from_serial(F.lit("43101"))) == date(2018, 1, 1)
    assert one(spark, Y.parse_date(F.lit("31/02/2018"), "dd/MM/yyyy")) is None
    assert [one(spark, Y.five_year(F.lit(y))) for y in (1997, 1998, 2002, 2003)] == [1995, 2000, 2000, 2005]
    b, e = Y.year_span(F.lit("from 13/09/2015 to 12/03/2016"))
    assert (one(spark, b), one(spark, e)) == (2015, 2016)
    b, e = Y.year_span(F.lit("4008/x"), {"4008": 2009})
    assert (one(spark, b), one(spark, e)) == (2009, 2009)


def test_html_tables_and_links():
    page = "<p>x<table><tr><th>A<th>B</tr><tr><td>1 &amp;\n 2<td><a href='q'>z</a><table><tr><td>in</table></table><td>out"
    assert _cells(page) == [(0, 0, ["A", "B"]), (0, 1, ["1 & 2", "z"]), (1, 0, ["in"])]
    page = "<table><tr><td>a<table><tr><td>in</table> b<br>c<td>d</tr><tr><td>e</table><table><td>f<td>g</table>"
    assert _cells(page) == [(0, 0, ["a b c", "d"]), (1, 0, ["in"]), (0, 1, ["e"]), (2, 0, ["f", "g"])]
    links = '<div class="nav hidden"><a href="/a?x=1&amp;y=2">One <b>two</b></a></div><a href="b">c</a><a name=d>e</a>'
    assert _anchors(links, None) == [["/a?x=1&y=2", "One two"], ["b", "c"]]
    assert _anchors(links, "hidden") == [["/a?x=1&y=2", "One two"]]
    assert _anchors('<br class="nav"><a href="a">x</a><p class="nav"><img class="q"><a href="b">y</a></p><a href="c">z', "nav") == [["b", "y"]]


def test_pages_without_tables_or_links(spark, rows):
    pages = spark.createDataFrame([(1, "http://x.org/a/", "<p>none"), (2, None, None)], "page_id BIGINT, url STRING, html STRING")
    assert html_tables(pages).count() == 0 and html_links(pages).count() == 0
    linked = spark.createDataFrame([(1, "http://x.org/a/", "<a href='../b'>t</a>")], "page_id BIGINT, url STRING, html STRING")
    assert rows(html_links(linked)) == [(1, 0, "../b", "http://x.org/b", "t")]
