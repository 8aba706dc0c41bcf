"""Toxic passages by maximum-scoring segments.

A token is a word in lower case; it is looked up whole and by its beginnings of a few lengths, and
scores by the most significant of these, for or against.  Scores are log-odds of the toxic against
the other labelled texts under a Dirichlet prior from both together, in document counts, drawn towards
zero by ``SHRINK`` of their standard errors; what is left is positive for toxic tokens and negative for
others, and a token without evidence has ``DRIFT``, so that a random text drifts down.  One linear
scan finds all maximal scoring segments of a text, however many.  The best segment of texts that
aren't toxic follows an extreme-value law in its excess over ``ln n``; its scale and place are fitted
on held-back rows, which gives each segment a p-value.  A text's score is a logistic curve over the
evidence of its best segment and of all significant ones.

Training reads ``per_class`` labelled rows of each class at most (the first by a hash of their
doc_id), two thirds for the lexicon, a third for the calibration.  All tokens of these rows are counted;
what is drawn to zero is no entry, so the lexicon is bounded by the sample.  A text without
positive tokens, null and empty ones included, has the curve's lowest score.  Without labels of both
classes every score is 0.  Repeated rows and null doc_ids are scored like others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash
from .quality import platt, sample

PER_CLASS = 6000
#: Beginnings of words that count as tokens besides the words.
STEMS = (3, 4, 5, 6, 7)
#: Weight of the prior in texts, standard errors that log-odds are drawn in by, score of tokens without evidence.
PRIOR, SHRINK, DRIFT = 200.0, 3.0, -0.05
#: Beginnings in so few texts must be telling before words explain them, too.
RARE = 8
SIGNIFICANT = 0.05
_STRIP = ".,;:!?\"'()[]{}<>|*#&%$-_"
_MEMO = 100_000


def tokens(word: str) -> list[str]:
    """The entries that a word may be scored by; beginnings end in ``*``."""
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) > k]]


class Scores(dict):
    """Scores of white-space-free chunks, remembered."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> float:
        if len(self) > _MEMO:
            self.clear()
        found = [self.lexicon[t] for t in tokens(chunk.lower().strip(_STRIP)) if t in self.lexicon]
        out = max(found, key=lambda e: (abs(e[0]), e))[1] if found else DRIFT
        if len(chunk) <= 64:
            self[chunk] = out
        return out


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in one pass.

    A candidate keeps the running sum before and after it and a link to the nearest earlier
    candidate with a smaller sum before; everything between them is passed over at once.
    """
    sums = list(accumulate(scores, initial=0.0))
    cand: list[tuple[int, int, int]] = []  # start, end, link
    for i, s in enumerate(scores):
        if s <= 0:
            continue
        start, end, j = i, i + 1, len(cand) - 1
        while True:
            while j >= 0 and sums[cand[j][0]] >= sums[start]:
                j = cand[j][2]
            if j < 0 or sums[cand[j][1]] >= sums[end]:
                break
            start, j, keep = cand[j][0], cand[j][2], j
            del cand[keep:]
        cand.append((start, end, j))
    return [(sums[b] - sums[a], a, b) for a, b, _ in cand]


def evidence(text: str | None, scores: Scores, law: tuple[float, float]) -> tuple[float, float, list[tuple[float, int, int]], int]:
    """(evidence of the best segment, of all significant ones, the latter as (p, start, end) in words, words).

    ``law`` is (lambda, ln K): the chance that a text of n words without toxic passages has a segment
    of score S or more is 1 - exp(-K n exp(-lambda S)).
    """
    words = (text or "").split()
    row = list(map(scores.__getitem__, words))
    best, total, kept = 0.0, 0.0, []
    if row and max(row) > 0:
        for s, a, b in segments(row):
            x = law[0] * s - law[1] - math.log(len(words))  # the Gumbel variate
            p = -math.expm1(-math.exp(-x)) if x > -6 else 1.0
            e = min(x if x > 30 else -math.log(max(p, 1e-300)), 700.0)
            best = max(best, e)
            if p < SIGNIFICANT:
                total += e
                kept.append((p, a, b))
    return best, total, kept, len(words)


def lexicon(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, tuple[float, float]]:
    """(z, score) by token from (token, toxic texts, other texts) and the classes' sizes.

    Beginnings are judged by what the commonest toxic whole word of the lexicon leaves unexplained of
    their counts, so that one toxic word does not taint every word that begins like it.
    """

    def judge(a: int, b: int) -> tuple[float, float] | None:
        if a + b == 0:
            return None
        prior = PRIOR * (a + b) / (toxic + other)
        odds = math.log((a + prior) / max(0.5, toxic + PRIOR - a - prior)) - math.log((b + prior) / max(0.5, other + PRIOR - b - prior))
        error = math.sqrt(1 / (a + prior) + 1 / (b + prior))
        left = abs(odds) - SHRINK * error
        if left <= 0:
            return None
        return odds / error, left if odds > 0 else min(DRIFT, -left)

    out: dict[str, tuple[float, float]] = {}
    explained: dict[str, tuple[int, int]] = {}
    for t, a, b in counts:
        if not t.endswith("*") and (found := judge(a, b)):
            out[t] = found
            if found[1] > 0:
                explained |= {x: max((a, b), explained.get(x, (0, 0))) for x in tokens(t)[1:]}
    for t, a, b in counts:
        less = explained.get(t, (0, 0))
        if t.endswith("*") and (a + b > RARE or judge(a, b)) and (found := judge(a - less[0], max(0, b - less[1]))):
            out[t] = found
    return out


def extreme_law(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """(lambda, ln K) of the best segments of texts that aren't toxic, by moments of S - ln(n)/lambda."""
    some = best > 0
    if some.sum() < 10:
        return 1.0, 0.0
    s, n = best[some], np.log(np.maximum(words[some], 1))
    rate = 1.0
    for _ in range(50):
        y = s - n / rate
        rate = min(5.0, max(0.05, math.pi / (math.sqrt(6) * max(float(y.std()), 1e-3))))
    # Texts without any positive token count as below everything seen.
    return rate, rate * (float((s - n / rate).mean()) - 0.5772156649 / rate) + math.log(some.mean())


class Model:
    """Lexicon, extreme-value law and curve; all bounded, so a model may be broadcast."""

    def __init__(self, known: dict, law: tuple[float, float], curve: tuple[float, float]):
        self.known, self.law, self.curve = known, law, curve

    def probability(self, best: float, total: float) -> float:
        if not self.known:
            return 0.0
        x = self.curve[0] * feature(best, total) + self.curve[1]
        return 1 / (1 + math.exp(-min(35.0, max(-35.0, x))))


def feature(best: float, total: float) -> float:
    """Evidence on a scale that very toxic texts don't dominate."""
    return math.log1p(best) + math.log1p(total)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: str = "true", per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows that the SQL predicate ``rows`` lets in."""
    spark = docs.sparkSession
    texts = stash(sample(docs, labels, label, rows, per_class).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))), "labelled")
    sizes = {(r["y"], r["held"]): r["n"] for r in texts.groupBy("y", (F.col("fold") == 0).alias("held")).agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if not toxic or not other:
        return Model({}, (1.0, 0.0), (1.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in seen]], names=["token", "other", "toxic"])
            seen[0].clear()
            seen[1].clear()
            return out

        for b in slices(batches):
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                words = {w.lower().strip(_STRIP) for w in set((text or "").split())}
                seen[y].update({t for w in words if w for t in tokens(w)})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield flush()
        yield flush()

    counts = (
        texts.filter("fold <> 0").mapInArrow(count, "token string, other long, toxic long").groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    )
    known = lexicon([tuple(r) for r in _telling(counts, toxic, other).collect()], toxic, other)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(known)
        for b in slices(batches):
            rows = []
            for text in b["text"].to_pylist():
                row = list(map(scores.__getitem__, (text or "").split()))
                found = [s for s, _, _ in segments(row)]
                rows.append((max(found, default=0.0), len(row)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], b["share"], b["text"], *[pa.array(c) for c in zip(*rows, strict=True)]], names=["doc_id", "y", "share", "text", "best", "words"])

    held = stash(texts.filter("fold = 0").mapInArrow(look, "doc_id long, y int, share double, text string, best double, words long"), "held")
    calm = held.filter("y = 0").select("best", "words").toPandas()
    law = extreme_law(calm["best"].to_numpy(), calm["words"].to_numpy())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(known)
        for b in slices(batches):
            made = [feature(*evidence(t, scores, law)[:2]) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], b["share"], pa.array(made, pa.float64())], names=["y", "share", "x"])

    points = held.mapInArrow(weigh, "y int, share double, x double").toPandas()
    if points["y"].nunique() < 2:
        return Model(known, law, (1.0, -feature(-math.log(SIGNIFICANT), 0)))
    return Model(known, law, platt(points["x"].to_numpy(), points["y"].to_numpy(float), points["share"].to_numpy()))


def _telling(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """The (token, a, b) that :func:`lexicon` can make entries of: what isn't drawn to zero, and beginnings that
    aren't rare, for words may explain some of their counts.  The driver holds these alone."""
    prior = F.lit(PRIOR / (toxic + other)) * (F.col("a") + F.col("b"))
    a, b = F.col("a") + prior, F.col("b") + prior
    odds = F.log(a / F.greatest(F.lit(0.5), F.lit(toxic + PRIOR) - a)) - F.log(b / F.greatest(F.lit(0.5), F.lit(other + PRIOR) - b))
    # A hair's breadth wider than the test that follows in floating point of the driver.
    return counts.filter((F.abs(odds) > 0.999999 * SHRINK * F.sqrt(1 / a + 1 / b)) | (F.col("token").endswith("*") & (F.col("a") + F.col("b") > RARE)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): passages are (p, start, end) in white-space-separated words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.law, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        scores = Scores(m.known)
        kind = pa.list_(pa.struct([("p", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches):
            found = [evidence(t, scores, m.law) for t in b["text"].to_pylist()]
            spans = [[{"p": p, "start": a, "end": z} for p, a, z in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([m.probability(f[0], f[1]) for f in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, passages array<struct<p: double, start: int, end: int>>")
