"""Every registered query with an oracle equals DuckDB on sf0.001; the rest run."""

import pytest

import __spark_entry__ as E
from cardsight.plans import registry
from oracle_check import compare, duck

from conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


# Layout-dependent sampling and sketches; each has a query beside it that checks their promise with SQL.
ROWS_ONLY = {"strat_sample_native": "strat_sample_native_share", "histogram_auto": "histogram_auto_exact",
             "box_stats_approx": "sketch_quartiles"}


def test_every_query_has_sql_or_is_known_not_to():
    registry.load_all()
    base, sql = set(registry.QUERIES), set(registry.ORACLE)
    assert base - sql == set(ROWS_ONLY) and sql <= base and set(ROWS_ONLY.values()) <= sql
    assert base <= set(QUERIES) and set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 36


registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE[name], con)
    assert r["status"] == "ok", r
