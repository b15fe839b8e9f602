"""Every registered query with a SQL twin, on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import check, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# the smallest table is too sparse for these
MAY_BE_EMPTY = {"f07_prepare_for_training", "r08_rule_actions", "t07_stream_zscore"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    problem = check(con, spark, name, QUERIES[name], SQL[name], FOLDER)
    if problem == "equal but empty":
        assert name in MAY_BE_EMPTY
    else:
        assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "seq", "timestamp", "value", "expected", "score", "severity"]
    assert df.count() > 0
