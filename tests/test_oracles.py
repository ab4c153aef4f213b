"""Every query that SQL can express, against DuckDB on the same tables."""

import datetime
import glob
import os

import duckdb
import pytest

from tesserae import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(records, columns):
    order = sorted(columns)
    plain = lambda x: None if x != x else str(x) if isinstance(x, datetime.date) else x
    return sorted((tuple(plain(x) for x in (r[c] for c in order)) for r in records), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    left = rows([r.asDict() for r in got.collect()], got.columns)
    right = rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a == pytest.approx(b, abs=2e-6), (a, b)


def test_names_are_catalogued():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 180
