"""A doc_id that names several texts."""

import pytest

pytest.importorskip("threadloom.llm")

from threadloom.llm import simhash  # noqa: E402


def test_simhash_drops_rows_not_ids(spark):
    a, b = "one two three four five six seven", "red green blue black white grey pink"
    docs = spark.createDataFrame([(5, a), (7, a.upper()), (5, b), (2, b.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in simhash.drop_near(docs, 3).collect()} == {(5, a), (2, b.upper())}
