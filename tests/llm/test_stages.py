"""Every stage of the pipeline on empty tables, nulls, repeated rows, long texts and clashing columns."""

import re

import pytest

pytest.importorskip("threadloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SMALL = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, fp long, root long, node long, score double, norm string, digest binary, keep array<int>, key string"
TEXTS = ["write to jo@mail.com", None, "", "  ", "write  to\tjo@mail.com", "one two three four five six seven eight nine ten eleven twelve", "One two three four five six seven eight nine ten eleven twelve", "word " * 300_000, "é" * 50]


def _rows():
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", None, 3), (None, "nameless", "en", "s", 8), (None, None, None, None, None)]
    return [(*r, 1, 2, 3, 0.5, "n", b"d", [1], "k") for r in rows]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_edges(spark, tmp_path, name, stage):
    spark.createDataFrame(_rows(), KINDS).repartition(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = stage(spark, docs, SMALL)
    rows = out.collect()
    none = stage(spark, docs.limit(0), SMALL)
    assert none.count() == 0 and none.columns == out.columns
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {None, *range(len(TEXTS))}
        return
    assert out.schema == docs.schema
    before, texts = [r["text"] for r in docs.collect()], [r["text"] for r in rows]
    if name == "exact_dedup":
        norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
        assert sorted(map(norm, texts)) == sorted({norm(t) for t in before})
    if name == "near_dedup":
        kept = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
        assert kept == [0, 1, 5, 7, 8] and len(rows) == len(kept) + 2
    if name == "pii":
        assert len(rows) == len(before) and not any("@" in (t or "") for t in texts)
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    if name == "quality":
        assert set(texts) <= set(before)


def test_near_stage_keeps_the_files_that_it_reads(spark, tmp_path):
    """Decisions are by place: more files and row groups than tasks, and a frame that is no scan of files."""
    rows = [(i, f"{'a b c d e f g h ' * (1 + i % 3)}{i // 3 % 5}") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.repartition(7).write.parquet(f"{tmp_path}/many")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/many").filter("doc_id >= 0")):
        for drop in (corpus_pipeline.drop_exact, corpus_pipeline.drop_near):
            left = {r.doc_id: r.text for r in drop(spark, docs, "").collect()}
            assert len(left) == len(set(left.values())) and all(i == min(j for j, t in rows if t == left[i]) for i in left)
