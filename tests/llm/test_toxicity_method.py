"""The lexicon and the extreme-value law against plain versions, precision and recall on held-out rows."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("threadloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from threadloom.llm import queries, toxicity  # noqa: E402

MIDDLE = "/root/testdata/sf0.1"


def _plain_lexicon(texts):
    """Signed, shrunken log-odds from (text, toxic) pairs, counted token by token over whole texts."""
    sizes = [sum(1 for _, y in texts if y == c) for c in (0, 1)]
    seen = {}
    for text, y in texts:
        own = set()
        for w in (text or "").split():
            w = w.lower().strip(toxicity._STRIP)
            if w:
                own.add(w)
                own |= {w[:k] + "*" for k in toxicity.STEMS if len(w) > k}
        for t in own:
            seen.setdefault(t, [0, 0])[y] += 1

    def judge(b, a):
        if not a + b:
            return None
        alpha = toxicity.PRIOR * (a + b) / sum(sizes)
        odds = 0
        for n, size, sign in ((a, sizes[1], 1), (b, sizes[0], -1)):
            odds += sign * math.log((n + alpha) / max(0.5, size + toxicity.PRIOR - n - alpha))
        error = math.sqrt(1 / (a + alpha) + 1 / (b + alpha))
        if abs(odds) <= toxicity.SHRINK * error:
            return None
        score = abs(odds) - toxicity.SHRINK * error
        return odds / error, score if odds > 0 else min(toxicity.DRIFT, -score)

    out = {t: judge(*n) for t, n in seen.items() if not t.endswith("*") and judge(*n)}
    for t, (b, a) in seen.items():
        if t.endswith("*") and (a + b > toxicity.RARE or judge(b, a)):
            whole = [(seen[w][1], seen[w][0]) for w, e in out.items() if not w.endswith("*") and e[1] > 0 and len(w) >= len(t) and w.startswith(t[:-1])]
            x, y = max(whole, default=(0, 0))
            if found := judge(max(0, b - y), a - x):
                out[t] = found
    return out


def test_lexicon(spark):
    rng = random.Random(4)
    bad, good, plain = ["vile", "vilest", "scum", "idiots"], ["kind", "please", "thanks"], [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        y = int(rng.random() < 0.4)
        words = [rng.choice(plain) for _ in range(rng.randrange(0, 40))] + [rng.choice(bad if y else good).upper() + "!" for _ in range(rng.randrange(0, 4))]
        rng.shuffle(words)
        rows.append((i, " ".join(words) if i % 20 else None))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("f")).collect()}
    texts = dict(rows)
    want = _plain_lexicon([(texts[i], y) for i, y in labels if fold[i]])
    model = toxicity.train(docs, known)
    assert model.known.keys() == want.keys() and any(e[1] > 0 for e in want.values()) and any(e[1] < toxicity.DRIFT for e in want.values())
    assert all(abs(model.known[t][k] - want[t][k]) < 1e-9 for t in want for k in (0, 1))
    assert {t for t, e in want.items() if e[1] > 0} >= {"scum", "idiots"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    scores = toxicity.Scores(want)
    for i, t in rows:
        best, total, _, _ = toxicity.evidence(t, scores, model.law)
        assert abs(got[i] - model.probability(best, total)) < 1e-12


def test_law_is_calibrated():
    """Steps of +1 and -1: the rate is known, ln(q/p), and p-values of clean texts are as rare as they say."""
    rng = np.random.default_rng(5)
    p = 0.3
    best, words = [], rng.integers(100, 1500, 800)
    for n in words:
        steps = np.where(rng.random(n) < p, 1.0, -1.0)
        best.append(max((s for s, _, _ in toxicity.segments(steps.tolist())), default=0.0))
    rate, k = toxicity.extreme_law(np.array(best), words)
    assert abs(rate - math.log((1 - p) / p)) < 0.2
    chance = np.array([-math.expm1(-math.exp(-(rate * s - k - math.log(n)))) for s, n in zip(best, words, strict=True)])
    for level in (0.05, 0.2):
        assert 0.4 * level < (chance < level).mean() < 1.8 * level


def test_held_out_precision_and_recall(spark):
    scored = queries.op2_toxicity(spark, MIDDLE).filter("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id")
    n = {(r.predicted, r.toxic): r.n for r in scored.groupBy("predicted", "toxic").agg(F.count("*").alias("n")).collect()}
    hit, false, missed = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit / (hit + false) >= 0.95 and hit / (hit + missed) >= 0.88
