"""The index against a scan, reopened and empty; vectors of the caller's own; many queries at once."""

from threadloom.operators import search

DOCS = [(1, "a", "red apples and green apples"), (2, "b", "a pear tree, pears"), (3, "c", None), (4, "d", ""), (5, "e", "apples 苹果树 pears"), (6, "f", "red red red")]
KIND = "doc_ord long, ref string, text string"


def test_index_equals_the_scan(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, KIND)
    at = f"file://{tmp_path}/index"
    for index in (search.Index(docs, at), search.Index(docs.limit(0), at), search.Index(docs)):
        for query in ("apples", "red pears red", "苹果", "nothing like it", "", "the"):
            got = {r.ref: round(r.score, 9) for r in index.bm25(query).collect() if r.score > 0}
            assert got == {r.ref: round(r.score, 9) for r in search.bm25(docs, query).collect() if r.score > 0}
    assert search.Index(docs.limit(0)).bm25("red").count() == 0
    assert search.Index(docs.filter("text is null or text = ''")).bm25("red").count() == 0


def test_vectors_are_made_once_a_text(spark):
    search.register_semantic(lambda texts: [[1.0, float(len(t))] if t else [0.0, 0.0] for t in texts], "lengths")
    docs = spark.createDataFrame([(i, r, "message", "user", "t", t) for i, r, t in DOCS + [(7, "g", DOCS[0][2])]], "doc_ord long, ref string, kind string, role string, title string, text string")
    rows = {r.ref: r.score for r in search.search(docs, "xx", "lengths", least=-1.0).collect()}
    assert rows["a"] == rows["g"] > 0 and rows["c"] == rows["d"] == 0 and len(rows) == 7
    assert search.search(docs, "xx", "no such algorithm").count() == 0


def test_many_queries_equal_single_ones(spark):
    docs = spark.createDataFrame([("x", *d) for d in DOCS] + [("y", 1, "a", "green pears only"), ("y", 2, "b", "red")], f"conv_id string, {KIND}")
    asked = spark.createDataFrame([("x", "1", "red apples red"), ("x", "2", "pears"), ("y", "1", "red"), ("z", "1", "red"), ("x", "3", None)], "conv_id string, query_id string, query string")
    got = {}
    for r in search.search_many(docs, asked, k=5).collect():
        got.setdefault((r.conv_id, r.query_id), []).append((r["rank"], r.ref, round(r.score, 9)))
    for conv, number, query in (("x", "1", "red apples red"), ("x", "2", "pears"), ("y", "1", "red")):
        best = search.top_k(search.bm25(docs.filter(f"conv_id = '{conv}'"), query), 5).collect()
        assert sorted(got.pop((conv, number))) == [(i + 1, r.ref, round(r.score, 9)) for i, r in enumerate(best)]
    assert not got


def test_embeddings_are_asked_for_in_small_parts(spark):
    """No call of the caller's embedding gets more than 512 texts; it was a whole batch of ten thousand rows."""
    search.register_semantic(lambda texts: [[1.0, float(len(texts))] for _ in texts], "parts")
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_ord", "cast(id AS string) AS ref", "'block' AS kind", "cast(null AS string) AS role", "concat('text ', id) AS text")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        scores = [r.score for r in search.search(docs, "x", "parts", k=3000, least=-2.0).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(scores) == 3000 and min(scores) > (1 + 512) / (2**0.5 * (1 + 512**2) ** 0.5) - 1e-9
