"""Ranked retrieval over documents (doc_ord, ref, kind, role, title, text).

One query is one pass over the texts: a document's length and its counts of the query's terms come out of
one function of its text, so no postings are shuffled; corpus statistics are one row, joined back as such.
For many queries over one corpus, :func:`postings` is the index; for many corpora, :func:`search_many`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import cosine, occurrences
from threadloom.functions.text import n_tokens, preview, query_bigrams, query_tokens, term_counts, tokens
from threadloom.sources import grouped
from threadloom.sources.tables import store_root, written

# The ranking's constants and weights.
K1, B = 1.2, 0.75
#: Asked terms that go along to the texts at most; of more, all terms of the texts are counted.
ASKED = 1 << 18
#: Weights of who speaks, applied after normalisation.
ROLE_WEIGHTS = {"user": 1.5, "assistant": 1.0, "tool": 0.6, "block": 1.0}
_ALGORITHMS: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def register(name: str, score: Callable[[DataFrame, str], DataFrame]) -> None:
    """``score(docs, query)`` gives docs with ``score``; a later one of the same name replaces it."""
    _ALGORITHMS[name] = score


def algorithms() -> list[str]:
    return list(_ALGORITHMS)


def block_docs(blocks: DataFrame) -> DataFrame:
    topic = F.coalesce("topic", F.lit(""))
    return blocks.select(
        "conv_id",
        F.col("block_num").cast("long").alias("doc_ord"),
        F.col("block_id").alias("ref"),
        F.lit("block").alias("kind"),
        F.lit(None).cast("string").alias("role"),
        F.coalesce("topic", "block_id").alias("title"),
        F.concat(topic, F.lit(" "), F.coalesce("summary", F.lit(""))).alias("text"),
    )


def message_docs(messages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return messages.select("conv_id", F.col("ord").alias("doc_ord"), F.col("id").alias("ref"), F.lit("message").alias("kind"), "role", F.concat("role", F.lit(": "), F.substring(text, 1, 60)).alias("title"), text.alias("text"))


def conversation_docs(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """A conversation's blocks and messages as one list; blocks come first where orders tie."""
    return block_docs(blocks).unionByName(message_docs(messages))


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, len, term, tf) of rows with ``_found``, what ``term_counts`` gives."""
    pairs = F.inline(F.arrays_zip(F.col("_found.terms").alias("term"), F.col("_found.tf").alias("tf")))
    return rows.select(*keys, F.col("_found.len").alias("len"), pairs).select(*keys, "len", "term", F.col("tf").cast("long").alias("tf"))


def postings(docs: DataFrame) -> DataFrame:
    """(conv_id if docs have it, ref, term, tf, len): the index for many queries.  A text is counted where it is, and
    nothing is shuffled; only where references repeat, their documents' rows meet as one."""
    keys = [c for c in ("conv_id", "ref") if c in docs.columns]
    rows = _exploded(docs.select(*keys, term_counts(F.col("text")).alias("_found")), *keys)
    if docs.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows.select(*keys, "term", "tf", "len")
    return rows.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def search_many(docs: DataFrame, asked: DataFrame, k: int = 10, least: float = 0.01) -> DataFrame:
    """BM25 of many queries over many corpora at once: ``asked(conv_id, query_id, query)`` each against the
    documents (conv_id, doc_ord, ref, text) of its conversation alone.  (conv_id, query_id, rank, ref, score).

    Texts are counted once whatever the number of queries, and only counts of terms that are asked for leave that pass
    (all counts, if more than ``ASKED`` are).  A term that a query repeats counts each time; of documents with one
    reference the first in order is ranked first.
    """
    terms = asked.select("conv_id", "query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("conv_id", "query_id", "term").agg(F.count("*").alias("times"))
    known = [r.term for r in terms.select("term").distinct().limit(ASKED + 1).collect()]
    own = ["conv_id", "doc_ord", "ref"]
    rows = written(docs.select(*own, term_counts(F.col("text"), known if len(known) <= ASKED else None).alias("_found")), "counts")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg("_found.len").alias("avg"))
    tf = _exploded(rows, *own).join(terms.select("conv_id", "term").distinct(), ["conv_id", "term"], "left_semi").groupBy(*own, "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("conv_id", "term").agg(F.count("*").alias("df"))
    parts = tf.join(df, ["conv_id", "term"]).join(sizes, "conv_id").join(terms, ["conv_id", "term"])
    norm = K1 * (1 - B + B * F.col("len") / F.coalesce(F.nullif("avg", F.lit(0.0)), F.lit(1.0)))
    part = F.col("times") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + norm)
    scored = parts.groupBy("conv_id", "query_id", "doc_ord", "ref").agg(F.sum(part).alias("score")).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("conv_id", "query_id").orderBy(F.desc("score"), "doc_ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("conv_id", "query_id", "rank", "ref", "score")


def _counts(docs: DataFrame, query: str, grams: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Docs without their texts, with ``_len``, ``_tf``, the counts of the query's terms, and ``_in``, how many of
    ``grams`` a text has."""
    terms = query_tokens(query)
    rows = docs.withColumn("_found", term_counts(F.col("text"), terms, grams))
    times = [F.coalesce(F.get("_found.tf", F.array_position("_found.terms", F.lit(q)).cast("int") - 1), F.lit(0)) for q in terms]
    return rows.withColumns({"_len": F.col("_found.len"), "_tf": F.array(*times).cast("array<int>"), "_in": F.col("_found.parts")}).drop("_found", "text", "title"), terms


def _bm25(rows: DataFrame, terms: list[str]) -> DataFrame:
    """A term that the query repeats counts each time."""
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.sum((F.col("_tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("_df"))
    rows = rows.crossJoin(F.broadcast(stats))  # one row of statistics
    norm = K1 * (1 - B + B * F.col("_len") / F.coalesce(F.nullif("_avg", F.lit(0.0)), F.lit(1.0)))
    parts = [F.log(1 + (F.col("_n") - F.col("_df")[i] + 0.5) / (F.col("_df")[i] + 0.5)) * (F.col("_tf")[i] * (K1 + 1)) / (F.col("_tf")[i] + norm) for i in range(len(terms))]
    score = sum((F.when(F.col("_tf")[i] > 0, p).otherwise(0.0) for i, p in enumerate(parts)), F.lit(0.0))
    return rows.withColumn("score", score).drop("_n", "_avg", "_df")


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """Every column but the texts, with ``score``."""
    rows, terms = _counts(docs, query)
    return (_bm25(written(rows, "scores"), terms) if terms else rows.withColumn("score", F.lit(0.0))).drop("_len", "_tf", "_in")


def _overlap(query: str) -> Column:
    """Share of the query's bigrams that a text has; a pair without blanks is in a text's set if it
    occurs in it at all."""
    grams = query_bigrams(query)
    if not grams:
        return F.lit(0.0)
    low = F.lower("text")
    return sum((low.contains(g).cast("int") for g in grams), F.lit(0)) / len(grams)


def fuzzy(docs: DataFrame, query: str) -> DataFrame:
    return docs.withColumn("score", F.coalesce(_overlap(query), F.lit(0.0)))


def substring(docs: DataFrame, query: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs.withColumn("score", sum((occurrences(low, t) for t in query.lower().split()), F.lit(0)).cast("double"))


def hybrid(docs: DataFrame, query: str, weight: float = 0.7) -> DataFrame:
    """Every column but the texts, with ``score``: both scores over their maxima."""
    grams = query_bigrams(query)  # their share is fuzzy's score
    rows, terms = _counts(docs, query, tuple(grams))
    rows = written(rows.withColumn("_fz", F.col("_in") / F.lit(max(1, len(grams)))), "scores")
    rows = (_bm25(rows, terms) if terms else rows.withColumn("score", F.lit(0.0))).drop("_len", "_tf", "_in")
    top = rows.agg(F.greatest(F.max("score"), F.lit(1e-9)).alias("_b"), F.greatest(F.max("_fz"), F.lit(1e-9)).alias("_f"))
    rows = rows.crossJoin(F.broadcast(top))
    return rows.withColumn("score", weight * F.col("score") / F.col("_b") + (1 - weight) * F.col("_fz") / F.col("_f")).drop("_b", "_f", "_fz")


def semantic(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    return vectors.withColumn("score", cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])))


def register_semantic(embed: Callable[[list[str]], list[list[float]]], name: str = "semantic") -> None:
    """An algorithm of embeddings that the caller makes: ``embed(texts)`` gives a vector each.

    It runs in batches of a bounded size on the executors, once for each distinct text, whatever the number of documents
    that share it; texts are told apart by their SHA-256, so documents meet their scores without them.  A vector of zeros
    scores 0.
    """
    schema = "_key string, _vector array<double>"

    def score(docs: DataFrame, query: str) -> DataFrame:
        text, shape = F.coalesce("text", F.lit("")), grouped.arrow_schema(schema)
        keyed = docs.withColumn("_key", F.sha2(text, 256))

        def stream(batches):
            found = ((k, [float(x) for x in v]) for part in grouped.some(grouped.texts(batches)) for (k, _), v in zip(part, embed([t for _, t in part]), strict=True))
            return grouped.batched(found, shape)

        known = keyed.select("_key", text.alias("_text")).dropDuplicates(["_key"])
        scored = semantic(grouped.pieces(known, "_key", "_text").mapInArrow(stream, schema), embed([query])[0], "_vector").select("_key", "score")
        return keyed.join(scored, "_key").select(*docs.columns, "score")

    register(name, score)


class Index:
    """A corpus tokenised once for many queries: postings in ``BUCKETS`` folders by a hash of the term, so a query
    reads those of its own terms alone, and the lengths of all documents.

    ``at`` is a folder that all executors share; without one, that of the session.  An index that is
    there already is opened as it is.
    """

    BUCKETS = 64

    def __init__(self, docs: DataFrame, at: str | None = None):
        spark = docs.sparkSession
        self.at = at or store_root(spark, "index")
        keys = [c for c in docs.columns if c not in ("text", "title")]
        try:
            spark.read.parquet(f"{self.at}/documents")
        except AnalysisException:
            # One shuffle puts a bucket's postings together; each task's come sorted, as the files want them.
            rows = postings(docs.select("ref", "text")).withColumn("bucket", self._bucket(F.col("term")))
            rows.repartition("bucket", F.pmod(F.xxhash64("ref"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.at}/postings")
            docs.select(*keys, n_tokens(F.col("text")).alias("len")).write.parquet(f"{self.at}/documents")
        self.documents = spark.read.parquet(f"{self.at}/documents")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.BUCKETS)).cast("int")

    def bm25(self, query: str) -> DataFrame:
        """(ref, score) of the documents that have a term of the query."""
        spark, times = self.documents.sparkSession, Counter(query_tokens(query))
        if not times:
            return self.documents.select("ref", F.lit(0.0).alias("score")).limit(0)
        asked = spark.createDataFrame(sorted(times.items()), "term string, times int").withColumn("bucket", self._bucket(F.col("term"))).collect()
        n, avg = self.documents.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()
        rows = spark.createDataFrame([], f"ref {dict(self.documents.dtypes)['ref']}, term string, tf long, len int, bucket int")
        if n and not self.documents.filter("len > 0").isEmpty():
            rows = spark.read.parquet(f"{self.at}/postings").filter(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("term").isin(list(times)))
        terms = F.broadcast(spark.createDataFrame([(r["term"], r["times"]) for r in asked], "term string, times int"))  # as many rows as the query has terms
        df = F.broadcast(rows.groupBy("term").agg(F.count("*").alias("df")))
        norm = K1 * (1 - B + B * F.col("len") / (avg or 1.0))
        part = F.col("times") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + norm)
        return rows.join(terms, "term").join(df, "term").groupBy("ref").agg(F.sum(part).alias("score"))


for _name, _score in (("bm25", bm25), ("fuzzy", fuzzy), ("substring", substring), ("hybrid", hybrid)):
    register(_name, _score)


def weigh_roles(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = ROLE_WEIGHTS | (weights or {})
    by = F.when(F.col("kind") != "message", w["block"]).when(F.col("role") == "user", w["user"]).when(F.col("role") == "assistant", w["assistant"]).otherwise(w["tool"])
    return scored.withColumn("score", F.col("score") * by)


def top_k(scored: DataFrame, k: int = 10, least: float = 0.01, ties: tuple[str, ...] = ("doc_ord",)) -> DataFrame:
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), *ties).limit(k)


def search(docs: DataFrame, query: str, algorithm: str = "hybrid", k: int = 10, least: float = 0.01, preview_size: int = 200, weights: dict[str, float] | None = None) -> DataFrame:
    """The k best documents with previews; of several with one reference the last speaks for all.
    An unknown algorithm finds nothing."""
    if algorithm not in _ALGORITHMS:
        return docs.withColumns({"score": F.lit(0.0), "preview": F.lit("")}).limit(0)
    said = docs.groupBy(F.col("ref").alias("_ref")).agg(F.max("doc_ord").alias("_ord"), F.max_by(F.struct("kind", "role"), "doc_ord").alias("_last"))
    scored = _ALGORITHMS[algorithm](docs, query).select(F.col("doc_ord").alias("_own"), "ref", "score").join(said, F.col("ref").eqNullSafe(F.col("_ref")))
    scored = weigh_roles(scored.select("_own", "_ref", "_ord", "score", "_last.kind", "_last.role"), weights)
    top = top_k(scored, k, least, ("_own",)).select("_own", "_ref", "_ord", "score")
    # Few rows meet the documents again, so texts stay where they are.
    best = docs.join(F.broadcast(top), (F.col("doc_ord") == F.col("_ord")) & F.col("ref").eqNullSafe(F.col("_ref")))
    best = best.orderBy(F.desc("score"), "_own").withColumn("doc_ord", F.col("_own"))
    return best.select(*docs.columns, "score", preview(F.col("text"), query, preview_size).alias("preview"))


def legacy_search(blocks: DataFrame, query: str) -> DataFrame:
    """Active blocks by occurrences in topic (0.15 each, 0.45 a term at most) and summary (0.04, 0.2), above 0.1."""
    terms = query.lower().split()
    topic, summary = (F.lower(F.coalesce(c, F.lit(""))) for c in ("topic", "summary"))
    parts = [F.least(occurrences(topic, t) * 0.15, F.lit(0.45)) + F.least(occurrences(summary, t) * 0.04, F.lit(0.2)) for t in terms]
    score = F.least(sum(parts, F.lit(0.0)), F.lit(1.0))
    return blocks.filter("active").withColumn("score", score).filter("score > 0.1")


def ranking_quality(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``results(query, ref, rank)`` against ``expected(query, ref)``: mrr, r1, r3 over all queries."""
    hit = expected.join(results, ["query", "ref"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    return hit.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("rank") <= 1).cast("int"), F.lit(0))).alias("r1"), F.avg(F.coalesce((F.col("rank") <= 3).cast("int"), F.lit(0))).alias("r3"))
