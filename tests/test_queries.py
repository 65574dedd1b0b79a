"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__
from arbalest.plans import catalogue

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 7)
    return value


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(str(tuple(map(plain, r))) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.load()[1]))
def test_query_matches_sql(spark, con, name):
    got = catalogue.load()[0][name](spark, DATA).toPandas()
    want = con.sql(catalogue.load()[1][name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
