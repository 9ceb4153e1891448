"""Every registered query gives the rows of its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from roadgrain.plans import catalog, oracle

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    want = _rows([d[0] for d in result.description], result.fetchall())
    assert got == want
    assert got[1], "no rows"
