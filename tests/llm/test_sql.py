"""The operators that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

pytest.importorskip("threadloom.llm")

from threadloom.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    frame = queries.queries()[name](spark, SMALL)
    result = con.sql(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in frame.collect()))) == sorted(map(repr, result.fetchall()))
