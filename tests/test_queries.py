"""Every query with SQL gives the same rows as DuckDB on the smallest tables; entry() runs."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from adloom import queries

DIR = "/root/testdata/sf0.001"


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rows, names = df.collect(), sorted(df.columns)
    if name not in entry.oracle_sql():
        assert rows
        return
    r = duck.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    assert Counter(tuple(_norm(x[n]) for n in names) for x in rows) == Counter(tuple(_norm(x[k]) for k in at) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
