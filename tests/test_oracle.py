"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import ROOT, compare, duck

FOLDER = f"{ROOT}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", list(SQL))
def test_agrees_with_sql(spark, con, key):
    result = compare(spark, con, key, QUERIES[key], SQL[key], FOLDER)
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["year", "state1", "state2", "dyad"] and df.count() > 0
