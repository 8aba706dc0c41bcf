"""Search, archives, classifiers' accuracy, and the pipeline."""

import base64
import hashlib
import io
import zlib

import numpy as np
import pytest

pytest.importorskip("threadloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from threadloom.llm import queries, quality, topk, warc  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (None, [0.1] * 6), (2005, [0.5] * 3), (2050, [1e300] * 6)]
    rows += [(3000, [1e9] * 6), (3001, [-1e9] * 6), (3002, [1e9, -1e9, 3e9, 0.0, 0.0, 0.5]), (3050, [1e200] * 6), (3051, [1.7e308] * 6)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, part string")
    got = {}
    for r in topk.exact_topk(frame, frame.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: [int(v) for v in np.floor(256 * np.array(x))] for i, x in rows if i is not None and x and all(v is not None and abs(v) < 1e308 for v in x)}
    clip = lambda s: min(2**63 - 1, max(-(2**63), s))
    for q in [i for i in good if i % 50 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, clip(-s)) for k, (s, i) in enumerate(scored)]
    assert topk.exact_topk(frame.limit(0), frame.limit(0)).count() == 0


def test_topk_over_many_groups(spark, monkeypatch):
    """Groups, slices and directory parts far smaller than in use: floors go from group to group."""
    for name, n in (("SLICE", 3), ("DIRECTORY", 512)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(0, 0.05, (60, 5)) for c in rng.normal(0, 1, (10, 5))] + [np.ones((300, 5))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(frame, frame.filter("vec_id % 7 = 0"), k=4, group=96).collect())
    y = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, len(y), 7):
        s = y @ y[q]
        best = sorted((i for i in range(len(y)) if i != q), key=lambda i: (-s[i], i))[:4]
        want += [(q, r + 1, i, s[i]) for r, i in enumerate(best)]
    assert got == sorted(want)


def test_topk_prunes(spark):
    """On the table itself, one group: most pairs are left before their last term."""
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").filter("embedding is not null").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.floor(256 * np.array([r["embedding"] for r in rows]))
    at = np.flatnonzero(ids % 50 == 0)
    stats = {}
    group = topk.Group(ids, x.astype(np.int64))
    out = {q: list(zip(v.tolist(), s.tolist(), strict=True)) for q, v, s in topk.search(ids[at], x[at].astype(np.int64), np.full(len(at), -np.inf), group, 5, stats)}
    full = (x[at] @ x.T).astype(np.int64)
    for i, q in enumerate(ids[at].tolist()):
        best = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-full[i, j], ids[j]))[:5]
        assert out[q] == [(int(ids[j]), int(full[i, j])) for j in best]
    assert stats["pairs"] == len(at) * len(ids)
    assert stats["scored"] < 0.2 * stats["pairs"] and stats["terms"] < 0.6 * 64 * stats["pairs"]


def test_warc(spark):
    pages = [(1, "u", "a"), (2, None, "a"), (3, "a b\r\nX: y", None), (4, "v", ""), (None, "w", "é😀" * 50_000), (5, "w", "é😀" * 50_000), (None, "n", "alone"), (6, "d", "dup"), (6, "d", "dup")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    uris = warc.write_archives(frame)
    rows = warc.read_archives(spark, uris).collect()
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        top = max((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        own = top is None or top == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else top, b if own else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    got = [tuple(bytes(r[n]) if n == "payload" and r[n] is not None else r[n] for n in names) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all("\n" not in r["url"] for r in rows)
    small = [r for r in warc.read_archives(spark, warc.write_archives(frame, least_bytes=2)).collect() if r["payload_bytes"] < 2]
    assert {r["record_type"] for r in small} == {"response"}
    assert warc.read_archives(spark, warc.write_archives(frame.limit(0))).count() == 0


@pytest.mark.parametrize("harm", [lambda d: d[:-3], lambda d: b"\x00" + d[1:], lambda d: d[:2000] + bytes([d[2000] ^ 255]) + d[2001:]])
def test_damaged_archive(tmp_path, harm):
    from threadloom.llm.common import Sink

    w = warc.ArchiveWriter(Sink(f"file://{tmp_path}/a.warc.zst", 0))
    rng = np.random.default_rng(0)
    for i in range(300):
        body = rng.bytes(200)
        w.add(warc.record(i, "u", body, len(body), hashlib.sha1(body).digest(), None))
    w.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    assert len([warc.page_row(warc.parse(x)) for x in warc.frames(io.BytesIO(data))]) == 300
    with pytest.raises(Exception):
        [warc.page_row(warc.parse(x)) for x in warc.frames(io.BytesIO(harm(data)))]


@pytest.mark.parametrize("name, label, least", [("op10_quality", "quality", 0.97), ("op2_toxicity", "toxic", 0.96)])
def test_held_out_accuracy(spark, name, label, least):
    scored = queries.queries()[name](spark, MIDDLE)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    assert scored.count() == 10_000
    right = scored.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= least


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, kept, before = docs.columns, {"start": docs.count()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        after.write.mode("overwrite").parquet(path := f"/tmp/threadloom-test-{name}")
        after = spark.read.parquet(path)
        assert after.columns == names
        old, new = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(new) <= set(old)
        kept[name] = len(new)
        if name == "exact_dedup":
            least = {}
            for i, t in old.items():
                t = " ".join(" ".join(t.replace("\x0b", " ").split("\x0c")).split(" ")) if t is None else __import__("re").sub("[\x20\x09-\x0d]+", " ", t)
                least[t] = min(i, least.get(t, i))
            assert set(new) == set(least.values())
        if name == "near_dedup":
            from .test_near import _kept

            assert sorted(new.items()) == sorted(_kept(sorted(old.items())))
        if name == "pii":
            from threadloom.llm.pii import base_spans

            assert set(new) == set(old) and not any(base_spans(t)[0] for t in new.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(new)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in pieces)
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert kept["start"] > kept["quality"] >= kept["exact_dedup"] >= kept["near_dedup"] == kept["pii"] > 0


def test_rejects_are_few_good_ones(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    w = quality.train(docs, labels, rows=corpus_pipeline.LEARN)
    good = docs.join(labels.filter("quality = 1"), "doc_id").filter(f"not ({corpus_pipeline.LEARN})")
    assert quality.keep(good, w, corpus_pipeline.QUALITY).count() >= 0.98 * good.count()
