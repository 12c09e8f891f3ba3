"""Every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "casegraph"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
