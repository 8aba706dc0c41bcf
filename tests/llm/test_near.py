"""The near-duplicate stage against brute-force Jaccard."""

import random
import re
from itertools import combinations

import pytest

pytest.importorskip("threadloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _kept(rows):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = up[i], up[j]
            up = [a if x == b else x for x in up]
    least = {}
    for (i, _), c in zip(rows, up, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted([r for r, c in zip(rows, up, strict=True) if r[0] is None or r[0] == least[c]], key=repr)


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_meets_jaccard(spark):
    """Edited copies on both sides of 0.8, a crowded group, a passage that unlike texts share, and blanks."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, line = [], fresh(12)
    for _ in range(12):
        base = fresh(rng.randrange(60, 200))
        texts += [base, *[_edited(rng, base, rng.randrange(1, 6)) for _ in range(2)]]
    crowd = fresh(180)
    texts += [_edited(rng, crowd, rng.randrange(1, 4)) for _ in range(40)]
    texts += [line + fresh(40) for _ in range(30)]
    rows = [*enumerate(map(" ".join, texts)), (500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a c"), (None, " ".join(crowd)), (None, "a b")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.drop_near(spark, docs, "")
    assert out.columns == docs.columns
    want = _kept(rows)
    assert len(want) < len(rows) - 40
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == want
