"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a whole text: its tokens (words in lower case, runs of other signs), each token pair,
and marks of chunks that repeat the one or two before; all hashed into ``2**BITS`` slots and weighed by
``1 + ln(count)``, scaled to length one.  Training takes ``per_class`` labelled doc_ids of each class
at most, the first by a hash, and of these the first that have ``FEATURES`` features together: documented
bounds, so one task can make the passes in a fixed order.  A doc_id that several rows share is one text in
training, the least of them; one with labels of both classes is left out.  A part of the sample is
held back to calibrate the intercept and slope.  A score is one sparse dot product a document.

Null and empty texts have the bias alone.  Rows with null doc_id are scored like others.  Without
labels of both classes every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, claim, slices, stash

BITS = 18
PER_CLASS = 6000
#: Features of the sample at most, eight bytes each in the task that trains.
FEATURES = 1 << 25
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.05, 6
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO = 100_000
#: Marks of a chunk that repeats the one before, or the two before.
_REPEATS = np.array([0xA5A5A5A5, 0x5A5A5A5B], np.uint32)


class Tokens(dict):
    """A white-space-free chunk to the hashes of its tokens, remembered."""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > _MEMO:
            self.clear()
        out = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in _TOKEN.findall(chunk.lower())], np.uint32).tobytes()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


_tokens = Tokens()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text; slot 0 is the bias."""
    chunks = (text or "").split()
    h = np.frombuffer(b"".join(map(_tokens.__getitem__, chunks)), np.uint32)
    if not len(h):
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:] * np.uint32(0x85EBCA77)
    same = np.fromiter(map(eq, chunks, islice(chunks, 1, None)), bool, len(chunks) - 1)
    marks = np.repeat(_REPEATS, [same.sum(), (same[1:] & same[:-1]).sum()])
    slots = np.concatenate([h, pair, marks]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    counts = np.bincount(slots, minlength=1) if len(slots) > 20_000 else None
    if counts is None:
        at, n = np.unique(slots, return_counts=True)
    else:
        at = np.flatnonzero(counts)
        n = counts[at]
    x = (1 + np.log(n)).astype(np.float32)
    x /= np.sqrt((x * x).sum())
    keep = at != 0
    return np.concatenate([[0], at[keep]]).astype(np.int64), np.concatenate([[1.0], x[keep] * 8]).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights after ``passes`` passes, in the rows' order; per-coordinate rates, L1 and L2."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    l1 = np.full(1 << BITS, L1)
    l1[0] = 0
    weigh = lambda at: np.where(np.abs(z[at]) <= l1[at], 0.0, (np.sign(z[at]) * l1[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
    for _ in range(passes):
        for at, x, y in rows:
            w = weigh(at)
            p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weigh(np.arange(1 << BITS)).astype(np.float32)


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve over raw scores, by Newton's steps with a light ridge."""
    x = np.stack([raw, np.ones_like(raw)], 1)
    w, weight = np.array([1.0, 0.0]), np.ones_like(raw) if weight is None else weight
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ ((p - y) * weight) + 1e-2 * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-2 * np.eye(2), g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], shares: tuple[float, float]) -> np.ndarray:
    """Weights with the calibration folded in.  ``shares``: rows of class 0 and 1 that each sampled row stands for."""
    if len({y for _, _, y in rows}) < 2:
        return np.zeros(1 << BITS, np.float32)
    fit = [r for i, r in enumerate(rows) if i % 4]
    rest = [r for i, r in enumerate(rows) if i % 4 == 0]
    w = ftrl(fit)
    y = np.array([r[2] for r in rest], float)
    if len(set(y)) == 2:
        raw = np.array([float(w[a] @ x) for a, x, _ in rest])
        slope, base = platt(raw, y, np.where(y == 1, shares[1], shares[0]))
        w = w * slope
        w[0] += base
    return w.astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label: str, train: str, per_class: int) -> DataFrame:
    """(doc_id, text, y, share) of up to ``per_class`` labelled doc_ids of each class, one row each; ``share``
    is the number of ids that each stands for.  The sampled ids are bounded, so they are broadcast."""
    known = labels.filter(train).filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("most"))
    known = known.filter("_id is not null and y = most").drop("most")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ordered = [known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    picked = ordered[0].union(ordered[1])
    share = F.when(F.col("y") == 1, F.lit(max(1.0, sizes.get(1, 0) / per_class))).otherwise(F.lit(max(1.0, sizes.get(0, 0) / per_class)))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    # The least text is found in each task before anything moves, however many rows one id has.
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y", share.alias("share"))


def _within(made: DataFrame, most: int) -> DataFrame:
    """The first rows by a hash of their doc_id that have ``most`` features together; a row a doc_id of the sample."""
    order = sorted(made.select("doc_id", F.size("at").alias("n")).collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    sums = np.cumsum([r["n"] for r in order]) if order else np.empty(0)
    if not len(sums) or sums[-1] <= most:
        return made
    kept = made.sparkSession.createDataFrame([(r["doc_id"],) for r, n in zip(order, sums, strict=True) if n <= most], "doc_id long")
    return made.join(F.broadcast(kept), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: str = "true", per_class: int = PER_CLASS) -> np.ndarray:
    """Weights from the labelled rows that the SQL predicate ``rows`` lets in."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _tokens)
        for b in slices(batches):
            made = [features(t) for t in b["text"].to_pylist()]
            cols = [b["doc_id"], b["y"], b["share"], pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "share", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        order = np.argsort([zlib.crc32(str(i).encode()) for i in t["doc_id"].to_pylist()], kind="stable")
        at, x, y = t["at"].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy()
        share = {int(k): float(s) for k, s in zip(y, t["share"].to_numpy(), strict=True)}
        w = learn([(at[i].astype(np.int64), x[i], int(y[i])) for i in order], (share.get(0, 1.0), share.get(1, 1.0)))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    picked = sample(docs, labels, label, rows, per_class)
    made = stash(picked.mapInArrow(prepare, "doc_id long, y int, share double, at array<int>, x array<float>"), "features")
    got = _within(made, FEATURES).repartition(1).mapInArrow(fit, "w binary").collect()  # the sample is bounded
    return np.frombuffer(got[0]["w"], np.float32) if got else np.zeros(1 << BITS, np.float32)


def _probability(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    raw = np.array([float(w[at].astype(np.float64) @ x) for at, x in map(features, texts)])
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _tokens)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(_probability(b["text"].to_pylist(), shared.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """``docs`` that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def change():
        claim("quality", _tokens)
        return lambda texts: (_probability(texts, shared.value) >= least, None)

    return by_text(docs, change)
