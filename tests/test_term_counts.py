"""Terms counted where the texts are."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom import queries
from threadloom.functions import text as X
from threadloom.operators import search
from threadloom.sources import tables

PARTS = "a b s 1 9 _ __ - . İ K é 苹果树 ヿ ing ation ment ness ies 's the_ _x9 \n licenses ß".split(" ") + [" "] * 8


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n=400):
    at = random.Random(7)
    texts = ["".join(at.choices(PARTS, k=at.randint(0, 40))) for _ in range(n)] + [None, "", "x" * 5000 + "s", "q" * 70 + "ing " * 3]
    return spark.createDataFrame(list(enumerate(texts)), "ref long, text string").withColumn("doc_ord", F.col("ref")).repartition(3)


def test_counts_are_those_of_the_tokens(spark, monkeypatch):
    rows = corpus(spark).select("text", X.tokens(F.col("text")).alias("t"), X.term_counts(F.col("text")).alias("c"), X.term_counts(F.col("text"), ["ab", "licens", "苹"]).alias("some")).collect()
    for r in rows:
        want = Counter(r.t)
        assert r.c.len == r.some.len == len(r.t) and dict(zip(r.c.terms, r.c.tf, strict=True)) == want
        assert dict(zip(r.some.terms, r.some.tf, strict=True)) == {t: want[t] for t in ("ab", "licens", "苹") if t in want}
    monkeypatch.setattr(X, "KNOWN", 3)  # what is kept of the words is bounded, and no count depends on it
    X._known.clear()
    for r in rows:
        assert X.count_terms(spark.range(1).select(F.lower(F.lit(r.text))).first()[0] if r.text and not r.text.isascii() else (r.text or "").lower())[1] == Counter(r.t)
        assert len(X._known) <= 3


def test_postings_are_not_shuffled(spark):
    """Every word of every text went through a shuffle, with its document's reference beside it."""
    docs = corpus(spark).select("ref", "text").localCheckpoint()
    rows = search.postings(docs)
    assert "Exchange" not in plan(rows)
    want = Counter((r.ref, t) for r in docs.select("ref", X.tokens(F.col("text")).alias("t")).collect() for t in r.t)
    assert {(r.ref, r.term): r.tf for r in rows.collect()} == want


def test_postings_of_repeated_references_are_one(spark):
    docs = spark.createDataFrame([("a", "red red apples"), ("a", "red pears"), (None, "red"), (None, "red"), ("b", "red")], "ref string, text string")
    got = {(r.ref, r.term): r.tf for r in search.postings(docs).collect()}
    assert got == {("a", "red"): 3, ("a", "apple"): 1, ("a", "pear"): 1, (None, "red"): 2, ("b", "red"): 1}


def test_an_index_writes_no_words(spark, monkeypatch):
    """Whole token arrays of all texts were written first, and postings were shuffled twice."""
    made = []
    monkeypatch.setattr(search, "written", lambda rows, label: made.append(label) or tables.written(rows, label))
    index = search.Index(corpus(spark).select("ref", "text"))
    assert index.bm25("licenses").count() > 0 and not made


def test_many_queries_read_texts_once(spark):
    """Texts were cut into words for the sizes, the vocabulary and the counts."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    docs = spark.range(40).coalesce(1).select(F.lit("c").alias("conv_id"), F.col("id").alias("doc_ord"), F.col("id").alias("ref"), F.concat(F.lit("red apples "), F.col("id").cast("string")).alias("text"))
    docs = docs.withColumn("text", told.asNondeterministic()("text"))
    asked = spark.createDataFrame([("c", "1", "red"), ("c", "2", "an apple")], "conv_id string, query_id string, query string")
    assert search.search_many(docs, asked, k=3).count() == 6 and read.value == 40


def test_more_terms_than_go_along(spark, monkeypatch):
    docs = corpus(spark).withColumn("conv_id", F.col("ref") % 3)
    asked = spark.createDataFrame([(i, "1", "licenses ab 苹果") for i in range(3)], "conv_id long, query_id string, query string")
    rows = lambda: sorted((*r[:4], round(r.score, 9)) for r in search.search_many(docs, asked, k=5).collect())
    few = rows()
    monkeypatch.setattr(search, "ASKED", 1)
    assert few and rows() == few


def test_one_query_counts_without_patterns(spark):
    """Hybrid and BM25 scores come of one count a text, not of patterns and lists of words."""
    docs = corpus(spark).withColumns({"kind": F.lit("message"), "role": F.lit("user")})
    rows, terms = search._counts(docs, queries.QUERY)
    assert "regexp" not in plan(rows) and terms
    want = {r.ref: r.t for r in docs.select("ref", X.tokens(F.col("text")).alias("t")).collect()}
    assert all(r["_len"] == len(want[r.ref]) and list(r["_tf"]) == [want[r.ref].count(q) for q in terms] for r in rows.collect())


def test_hybrid_counts_bigrams_with_the_terms(spark):
    docs = corpus(spark)
    for query in ("licenses the ment", "苹果树", "a b", ""):
        rows = {r.ref: r["_in"] for r in search._counts(docs, query, tuple(X.query_bigrams(query)))[0].collect()}
        want = {r.ref: r.score * len(X.query_bigrams(query)) for r in search.fuzzy(docs, query).collect()}
        assert rows == {k: round(v) for k, v in want.items()}
        assert search.hybrid(docs, query).count() == len(want)


def test_texts_reach_the_count_in_bounded_batches(spark):
    """Long texts don't make a batch of ten thousand of them: what Python holds at once is bounded by bytes."""

    @F.arrow_udf("long")
    def together(texts: "pa.Array") -> "pa.Array":
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    docs = spark.range(300).coalesce(1).select(F.repeat(F.lit("a word "), 100_000).alias("text"))
    assert docs.select(together("text").alias("n")).agg(F.max("n")).first()[0] < 100 << 20
