"""Every query against its SQL on the smallest tables; the queries without SQL run and have a stable schema."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return c


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert len(df.collect()) >= 0


def test_entry(spark):
    assert entry.entry(spark).collect()[0].km > 0
