"""Training samples stay bounded: repeated doc_ids, contradictory labels, many features."""

import numpy as np
import pytest

pytest.importorskip("threadloom.llm")

from threadloom.llm import quality, toxicity  # noqa: E402


def test_repeats_and_contradictions(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "two"), (2, None), (3, "three"), (4, "four"), (None, "none")]
    docs = spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id long, text string, y int, _id int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (None, 1), (9, 0), (5, None), (4, 7)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.text, r.y) for r in quality.sample(docs, labels, "quality", "true", 5).collect())
    assert got == [(1, "text 0", 1), (2, "two", 0), (4, "four", 1)]
    assert quality.sample(docs, labels, "quality", "true", 1).count() <= 2
    assert toxicity.train(docs, labels.withColumnRenamed("quality", "toxic")).curve is not None


def test_features_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    made = quality.sample(docs, labels, "quality", "true", 100).selectExpr("doc_id", "array(1, 2, 3) as at")
    assert quality._within(made, 1000).count() == 40
    assert quality._within(made, 30).count() == 10
    assert quality._within(made, 2).count() == 0
    assert quality.train(docs, labels).any()


def test_very_long_texts(spark):
    rows = [(i, ("good words here " if i % 2 else "bad bad words ") * (200_000 if i < 2 else 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    w = quality.train(docs, labels)
    assert all(np.isfinite(r.score) for r in quality.score(docs, w).collect())
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scored) == 40 and all(0 <= s <= 1 for s in scored.values())
