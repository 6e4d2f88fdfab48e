"""Physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import ROOT

FOLDER = f"{ROOT}/sf0.001"
QUERIES = entry.queries()
SLOW = {"impute_chained", "sink_imputed", "fit_multinomial", "pool_rubin", "vcov_cluster"}


def plan(spark, key):
    return QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in SLOW])
def test_no_cross_join_and_early_first_row(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if re.search(r"Window \[row_number\(\)", text):
        assert "WindowGroupLimit" in text


def test_date_range_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_between")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>", text)


def test_group_values_do_not_use_a_window_per_group(spark):
    for key in ("win_group_total", "win_group_n", "win_group_mean"):
        assert "Window [" not in plan(spark, key)
