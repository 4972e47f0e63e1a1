"""Every registered query with an SQL twin gives the same rows as DuckDB on the small tables."""

import sys

import duckdb
import pytest

from fieldspark import catalog
from fieldspark.fixtures import BASE

sys.path.insert(0, "tools")
from tools.check_oracle import canon  # noqa: E402

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, rows) == canon(cols, cur.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
