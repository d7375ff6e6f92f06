"""Every registered query with oracle SQL agrees with DuckDB on the small scale factor."""

import pytest

import __spark_entry__ as E
from tests.compare import duck, same

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_small, con, key):
    same(QUERIES[key](spark, sf_small), con, ORACLE[key])


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, sf_small, key):
    df = QUERIES[key](spark, sf_small)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "weekly_departures" in df.columns
