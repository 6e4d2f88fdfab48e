"""The whole panel on a handful of countries, checked by hand."""

import math

import pytest

from dyadspark.plans.border_panel import Sources, border_panel, typed_panel


@pytest.fixture(scope="module")
def panel(spark):
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    s = Sources(
        contiguity=make(
            "state1no INT, state2no INT, year INT, conttype INT",
            (1, 2, 2016, 1), (2, 1, 2016, 1), (2, 345, 2016, 1), (345, 2, 2016, 1), (1, 2, 2015, 1), (1, 3, 2016, 2), (4, 5, 2016, 1),
        ),
        number_codes=make("number INT, code STRING", (1, "AAA"), (2, "BBB"), (4, "ARE"), (5, "QAT"), (345, "YUG")),
        regime_codes=make("scode STRING, code STRING", ("A", "AAA"), ("B", "BBB")),
        agreements=make("state1 STRING, state2 STRING, settle INT", ("AAA", "BBB", 1), ("BBB", "AAA", 1)),
        indicators=make(
            "code STRING, pop DOUBLE, gdp DOUBLE, military_pers DOUBLE, military_expenditure_perc_gdp DOUBLE, gdp_2014 DOUBLE",
            ("AAA", 1000.0, 50.0, 10.0, 2.0, 400.0), ("BBB", 2000.0, 100.0, 0.0, 1.0, 800.0), ("SRB", 500.0, 0.0, None, None, 0.0),
        ),
        trade=make("ccode1 INT, ccode2 INT, year INT, flow1 DOUBLE, flow2 DOUBLE", (1, 2, 2014, 30.0, 10.0), (1, 345, 2014, 10.0, -9.0)),
        regimes=make("scode STRING, year INT, polity2 INT", ("A", 2017, 7), ("B", 2017, -3), ("A", 2016, 0)),
        religions=make("state INT, year INT, chrstcat INT, chrstorth INT, islmsun INT, hindgen INT", (1, 2010, 5, 6, 10, 0), (2, 2010, 1, 1, 9, 3), (345, 2010, 0, 0, 1, 8)),
        disputes=make("statea INT, stateb INT, year INT, strtyr INT, outcome INT", (1, 2, 1999, 1999, 1), (1, 2, 2005, 2004, 6), (2, 345, 2003, 1998, 2)),
        incidents=make("code STRING, iyear INT, nkill DOUBLE, nwound DOUBLE", ("AAA", 2017, 3.0, 1.0), ("AAA", 2017, None, 0.0), ("BBB", 2016, 9.0, 0.0)),
        refugees=make("asylum_ccode INT, origin_ccode INT, year INT, ylinpol DOUBLE", (1, 2, 2015, 100.0), (1, 345, 2015, 50.0), (2, 1, 2014, 7.0), (667, 2, 2015, 9.0)),
        gravity=make(
            "iso3_o STRING, iso3_d STRING, year INT, heg_o INT, heg_d INT, col_dep_ever INT, comlang_off INT, comrelig DOUBLE",
            ("AAA", "BBB", 2019, 1, 0, 1, 1, 0.5), ("BBB", "AAA", 2019, 0, 1, 1, 1, 0.5), ("AAA", "AAA", 2019, 0, 0, 0, 1, 1.0),
        ),
        neighbours=make("state1 STRING, state2 STRING, km DOUBLE, terrain STRING", ("AAA", "BBB", 12.5, "flat"), ("BBB", "AAA", 12.5, "hills")),
        terrain=make("statea INT, stateb INT, year INT, rti DOUBLE", (2, 1, 2001, 0.4), (1, 2, 2001, 0.9)),
    )
    return {(r.state1, r.state2): r.asDict() for r in border_panel(s).collect()}


def test_pairs(panel):
    assert set(panel) == {("AAA", "BBB"), ("BBB", "AAA"), ("BBB", "SRB"), ("SRB", "BBB"), ("NGA", "TCD"), ("TCD", "NGA")}
    assert panel["AAA", "BBB"]["dyadName"] == panel["BBB", "AAA"]["dyadName"] == "AAA_BBB"
    assert panel["AAA", "BBB"]["dyadID"] == panel["BBB", "AAA"]["dyadID"] == 1 and panel["NGA", "TCD"]["dyadID"] == 3


def test_attributes(panel):
    ab, bs = panel["AAA", "BBB"], panel["BBB", "SRB"]
    assert ab["ratio_gdp"] == 0.5 and bs["ratio_gdp"] is None and ab["state1_military_pers_p1000"] == 10.0
    assert ab["state2_pop_log"] == pytest.approx(math.log1p(2000)) and bs["state2_military_pers_log"] is None
    assert (ab["diff_pol"], ab["absdiff_pol"], panel["BBB", "AAA"]["diff_pol"]) == (10, 10, -10)
    assert (ab["settle"], bs["settle"]) == (1, None)


def test_trade_and_refugees(panel):
    ab, ba = panel["AAA", "BBB"], panel["BBB", "AAA"]
    assert (ab["import"], ab["export"], ab["share_import"], ab["share_export"]) == (30.0, 10.0, 75.0, 100.0)
    assert (ba["import"], ba["export"], ba["share_export"]) == (10.0, 30.0, 75.0)
    assert ab["economic_dependence"] == 0.1
    assert (ab["refugees_incoming"], ab["refugees_incoming_agg"], ab["refugees_incoming_pc"]) == (100.0, 150.0, 0.1)
    assert (ba["refugees_outgoing"], ba["refugees_outgoing_agg_pc"], ba["refugees_incoming"]) == (100.0, 0.15, None)


def test_labels_and_flags(panel):
    ab, ba, bs = panel["AAA", "BBB"], panel["BBB", "AAA"], panel["BBB", "SRB"]
    assert (ab["state1_relig"], ab["state2_relig"], bs["state2_relig_shrt"]) == ("chrst", "islm", "other")
    assert (ab["diff_relig"], ab["state2_muslim"], bs["diff_relig_shrt"], panel["NGA", "TCD"]["diff_relig"]) == (1, 1, 1, None)
    assert (ab["disp_from_2000"], ab["disp_year"], bs["disp_from_2000"], ba["disp_from_2000"]) == (1, 2005, 0, 0)
    assert (ab["state1_nterror"], ab["state1_death_toll"], ab["state2_nterror"]) == (2, 3.0, 0)
    assert (ab["colonial_status"], ba["colonial_status"], bs["colonial_status"]) == ("colonizer", "colonized", None)
    assert (ab["blength"], ab["terrain"], bs["blength"]) == (12.5, "flat", None)
    assert ab["rti"] == ba["rti"] == 0.4


def test_typed_panel(spark, rows):
    panel = spark.createDataFrame([("AAA", "XKX", 3)], "state1 STRING, state2 STRING, n INT")
    kinds = [("AAA", "XKX", "wall"), ("AAA", "XKX", "wall"), ("XKX", "AAA", "open"), ("ARE", "QAT", "wall"), ("AAA", "CCC", None)]
    places = spark.createDataFrame([("AAA", "Africa", "North"), ("XKX", None, None)], "code STRING, continent STRING, region STRING")
    got = typed_panel(panel, spark.createDataFrame(kinds, "state1 STRING, state2 STRING, typology STRING"), places)
    assert rows(got.select("state1", "state1_typology", "state2_typology", "n", "continent1", "region2")) == [
        ("AAA", "wall", "open", 3, "Africa", "Southern Europe"),
        ("XKX", "open", "wall", None, "Europe", "North"),
    ]
