"""Every registered query against its SQL form on the smallest scale; queries without one must run and keep a schema."""
import check
import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, _, ok = check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["group_by", "group"]
