"""Every SQL-expressible query equals its DuckDB twin (row count, columns,
values) on the smallest scale, where one-arm cells exercise the fallbacks."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_harness import compare, duck

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql_twin(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    assert res.get("ok"), res


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"est", "se", "ci_lo", "ci_hi"}
