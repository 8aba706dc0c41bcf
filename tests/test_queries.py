"""Every query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from threadloom import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/**/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, float) else list(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, duck, name):
    frame = own.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    result = duck.sql(own.oracle_sql()[name])
    there = [d[0] for d in result.description]
    assert sorted(there) == names
    want = sorted(repr([plain(r[there.index(c)]) for c in names]) for r in result.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(own.queries()) == set(own.oracle_sql())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(own.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
