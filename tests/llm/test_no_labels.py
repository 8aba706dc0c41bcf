"""The quality stage where nothing can be learnt."""

import pytest

pytest.importorskip("threadloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("ids", [(), (1, 3, 4)])
def test_quality_keeps_all_without_both_classes(spark, tmp_path, ids):
    docs = spark.createDataFrame([(i, f"some clean text {i}") for i in range(8)], "doc_id long, text string")
    spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == 8
