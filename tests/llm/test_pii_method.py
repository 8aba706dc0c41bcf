"""Weak supervision: candidates, estimates and added spans against plain versions."""

import math
import random
import time

import numpy as np
import pytest

pytest.importorskip("threadloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from threadloom.llm import pii  # noqa: E402


def _plain_loose(text, base, failed):
    more = [(a, k, b) for a, k, b in failed if b - a >= 13]
    more += [(m.start(), 3, m.end()) for m in pii._GROUPS.finditer(text)]
    more += [(m.start(), 0, m.end()) for m in pii._WRITTEN.finditer(text)] + [(m.start(), 1, m.end()) for m in pii._QUADS.finditer(text)]
    out = []
    for a, k, b in sorted(more):
        if all(b <= x or a >= y for x, _, y in base) and all(b <= x or a >= y for x, _, y in out):
            out.append((a, k, b))
    return out


def _text(rng):
    parts = ["call", "tel", "mail", "at", "card", "order", "\n", "(212) 555-0133", "212 555 0133", "+1 212 555 0133", "jo [at] mail [dot] com", "jo@mail.com", "10[.]0[.]0[.]1", "10.0.0.1", "4111 1111 1111 1111", "4111 1111 1111 1112", "1234567890123", "é", "v1.2.3.4", "00.1.2.3"]
    return " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))


def test_candidates_in_linear_time():
    rng = random.Random(1)
    for _ in range(300):
        t = _text(rng)
        base, failed = pii.base_spans(t)
        assert pii.loose_spans(t, base, failed) == _plain_loose(t, base, failed)
    long = "jo@mail.com 212 555 0133 x " * 20_000
    base, failed = pii.base_spans(long)
    began = time.time()
    assert len(pii.loose_spans(long, base, failed)) == 20_000
    assert time.time() - began < 5


def test_estimates_go_to_the_truth():
    """Votes of known reliability: shares and chances come out, and the prior fades with the data."""
    rng = np.random.default_rng(3)
    right = np.array([0.9, 0.8, 0.75, 0.7, 0.85, 0.65])  # of a labeler that votes
    votes = np.array([1.0, 0.9, 0.6, 0.5, 0.9, 0.8])
    errors = []
    for n in (300, 60_000):
        truth = rng.random(n) < 0.35
        says = np.where(rng.random((n, 6)) < right, truth[:, None], ~truth[:, None])
        x = np.where(rng.random((n, 6)) < votes, np.where(says, 1, 2), 0)
        patterns, at, count = np.unique(["".join(map(str, r)) for r in x], return_inverse=True, return_counts=True)
        q, table, share = pii.estimate(patterns.tolist(), count.astype(float))
        want = np.stack([np.stack([1 - votes, votes * (1 - right), votes * right], 1), np.stack([1 - votes, votes * right, votes * (1 - right)], 1)], 1)
        errors.append(np.abs(table - want).max())
        assert abs(share - 0.35) < (0.15 if n < 1000 else 0.02)
        assert ((q[at] > 0.5) == truth).mean() > 0.85
    assert errors[1] < 0.03 and errors[1] < errors[0]


def _plain_estimate(votes):
    """The same model over single spans, without counts or arrays."""
    q = [0.95 if v[0] == "1" else 0.3 for v in votes]
    for _ in range(500):
        table = [[[(pii._STRICT if i == 0 else pii._PRIOR)[t][k] for k in range(3)] for t in range(2)] for i in range(pii.LABELERS)]
        for v, p in zip(votes, q, strict=True):
            for i, c in enumerate(v):
                table[i][0][int(c)] += 1 - p
                table[i][1][int(c)] += p
        share = (sum(q) + 1) / (len(q) + 2)
        new = []
        for v in votes:
            odds = math.log(share) - math.log(1 - share)
            for i, c in enumerate(v):
                odds += math.log(table[i][1][int(c)] / sum(table[i][1])) - math.log(table[i][0][int(c)] / sum(table[i][0]))
            new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
        if max(abs(a - b) for a, b in zip(new, q, strict=True)) < 1e-9:
            break
        q = new
    return q


def test_added_spans(spark):
    rng = random.Random(2)
    rows = [(i, _text(rng)) for i in range(150)] + [(150, None), (151, ""), (None, "tel 212 555 0133")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(3)
    every = [(i, c) for i, t in rows for c in pii.candidates(t)]
    trust = {}
    for kind in range(4):
        votes = [c["votes"] for _, c in every if c["kind"] == kind]
        trust |= {(kind, v): p for v, p in zip(votes, _plain_estimate(votes), strict=True)}
    counts = {}
    for _, c in every:
        counts[c["kind"], c["votes"]] = counts.get((c["kind"], c["votes"]), 0) + 1
    got = pii.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert got.keys() == trust.keys() and all(abs(got[k] - trust[k]) < 1e-6 for k in trust)
    place = spark.createDataFrame([(i, c["start"], c["kind"], n) for n, (i, c) in enumerate(every)], "doc_id long, start int, kind int, n int")
    order = [r.n for r in place.orderBy(F.xxhash64("doc_id", "start", "kind"), "kind").collect()]
    weights = pii.classifier([(every[n][1]["slots"], trust[every[n][1]["kind"], every[n][1]["votes"]]) for n in order])
    want = []
    for i, t in rows:
        kept = [c for c in pii.candidates(t) if c["base"] or weights[c["slots"]].sum() > 0]
        want.append((i, sorted((c["start"], c["kind"], c["end"], c["base"]) for c in kept)))
    found = [(r["doc_id"], sorted((s["start"], s["kind"], s["end"], s["base"]) for s in r["spans"])) for r in pii.find(docs).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert any(not s[3] for _, spans in want for s in spans)
