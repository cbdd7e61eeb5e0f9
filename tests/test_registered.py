"""Registered queries against their oracle SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_only_model_and_random_queries_lack_an_oracle():
    rest = [name for name in ROWS_ONLY if not name.startswith("op") and name != "pipeline"]
    assert rest == ["forecast_benchmark", "forecast_days", "forecast_model", "tune"]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_matches_oracle(spark, connection, name):
    verdict, _rows, _spark_seconds, _sql_seconds = compare(spark, connection, SF_DIR, name)
    assert verdict == "ok", verdict


def test_entry(spark):
    assert entry.entry(spark).columns == entry.queries()["mining_pass"](spark, SF_DIR).columns
