"""Every catalog query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import catalog


@pytest.fixture(scope="module")
def duck(tiny_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{tiny_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 5)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, tiny_dir, duck, name):
    df = catalog.QUERIES[name](spark, tiny_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_all_queries_have_sql_or_tests():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
