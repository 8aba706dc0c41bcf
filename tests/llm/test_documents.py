"""Operators over documents against plain versions, with nulls, blanks, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
pytest.importorskip("threadloom.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from threadloom.llm import byte_bpe, exact_dedup, packing, pii, quality, simhash, token_files, toxicity  # noqa: E402

RANKS, WORDS = pt.path("byte_bpe_multi_50k.tiktoken"), pt.path("word_bpe_49k.json")
LONG = "z y " * 30_000
ROWS = [
    *[(1, "a b  c"), (2, "a b\tc"), (3, None), (4, ""), (5, "   "), (None, "x"), (None, "a b c"), (7, LONG), (8, LONG)],
    *[(1, "a b  c"), (9, "é" * 10), (10, "Call +1 (017) 555-7713 or mail jo.81@mail7.example.com now"), (11, "A B C"), (12, "\x1c a b c")],
    *[(20 + i, f"one two three four five six seven eight nine ten eleven {i % 7}") for i in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, b"d", [1], 0.5, "n", i) for i, t in ROWS]
    kinds = "doc_id long, text string, fp string, block int, digest binary, ids array<int>, score double, norm string, key long"
    return spark.createDataFrame(rows, kinds).repartition(3)


def flat(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_golomb():
    for n, top in ((0, 1), (1, 10), (5, 5), (1000, 1 << 44), (1000, 2000)):
        v = np.sort(np.random.default_rng(n).choice(top, n, replace=False) if top < 1e6 else np.unique(np.random.default_rng(n).integers(0, top, n)))
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v)) == v).all()


def test_exact_dedup(docs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    expected = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        once = [keep is not None or len(ids) == 1]
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and once.pop() if once else False
            expected.append((i, keep, len(ids), bool(kept), hashlib.sha256(t.encode()).hexdigest()))
    assert flat(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)


def test_drop_copies(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    texts = Counter(re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in out.collect())
    assert set(texts.values()) == {1} and len(texts) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in ROWS})


def test_byte_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = [(i, len(x := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    assert flat(byte_bpe.round_trip(docs, RANKS, pt.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    made = byte_bpe.encode(docs, RANKS, pt.PATTERN)
    assert Counter(r["data"].decode() for r in byte_bpe.decode(made, RANKS, pt.PATTERN).collect()) == Counter(t or "" for _, t in ROWS)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoders_agree_with_their_libraries(text):
    import tiktoken

    from threadloom.llm.word_ids import word_ids

    codec = byte_bpe.byte_bpe(RANKS, pt.PATTERN)
    if not hasattr(codec, "reference"):
        codec.reference = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert codec.encode([text])[0].tolist() == codec.reference.encode_ordinary(text)
    words = word_ids(WORDS)
    assert words.encode([text])[0].tolist() == words.tok.encode(text, add_special_tokens=False).ids


def _ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    return [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in ROWS]


@pytest.mark.parametrize("windows", [1, 3])
def test_packing(docs, windows):
    rows = packing.pack(docs, WORDS, 2, open_windows=windows).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    unique = Counter(i for i, _ in ROWS)
    for i, ids in _ids():
        if unique[i] == 1:
            got = [x for _, part in sorted(pieces[i]) for x in part]
            assert got == ids.tolist()
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in _ids())


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 31])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, width), width, len(ids)) == ids).all()


def test_token_files(spark, docs):
    manifest = token_files.write_tokens(docs, WORDS, 2)
    key = lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or "")
    want, at = [], 0
    for (i, _), ids in sorted(zip(ROWS, (x for _, x in _ids()), strict=True), key=key):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = flat(token_files.read_tokens(spark, manifest, digest=True), "start", "doc_id", "n_tokens", "ids_crc32")
    assert sorted(got) == [(s, i, n, c) for i, s, n, c in want] or sorted(got, key=lambda r: r[0]) == [(s, i, n, c) for i, s, n, c in want]
    with token_files.TokenFile(max(manifest, key=lambda m: m[3])[0]) as f:
        whole = f.read(0, f.n_ids)
        for a, b in ((0, 1), (5, 5), (f.n_ids - 3, f.n_ids), (f.n_ids // 2, f.n_ids // 2 + 7)):
            assert (f.read(a, b) == whole[a:b]).all()


def _fingerprint(text, k):
    xxhash = pytest.importorskip("xxhash")
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("run", [1, 32])
def test_simhash(docs, run):
    fps = [_fingerprint(t, 3) for _, t in ROWS]
    label = _components(fps)
    least = {c: min((ROWS[i][0] for i in range(len(ROWS)) if label[i] == c and ROWS[i][0] is not None), default=None) for c in label}
    want = sorted(((ROWS[i][0], f"{fps[i]:016x}", least[label[i]]) for i in range(len(ROWS))), key=repr)
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_groups(docs, 3, run).collect()]
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("run", [2, 32])
def test_links_of_crowded_keys(spark, run):
    """Fingerprints around a few centres, so that keys are crowded: no link may be lost."""
    rng = random.Random(5)
    fps = {0}
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    label = _components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    meet = frame.mapInArrow(simhash._variants, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = meet.mapInArrow(simhash._linker(run), "u long, v long")
    pairs = found.filter("v is not null").distinct()
    crowd = found.filter("v is null").select(found["u"].alias("fp")).distinct()
    stars = crowd.mapInArrow(simhash._flips, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(simhash._stars, "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(pairs.union(stars)).collect()}
    got = defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x)
    want = defaultdict(set)
    for x, c in zip(signed, label, strict=True):
        want[c].add(x)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def _base(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            fine = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and _luhn(d), 9 <= len(d) <= 15][k]
            out += [(m.start(), k, m.end())] if fine else []
    return sorted(out)


def _luhn(d):
    n = [int(c) for c in reversed(d)]
    return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.-+ ()@ab_%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text)[0] == _base(text)


def test_pii(docs):
    rows = pii.digest(pii.find(docs)).collect()
    assert len(rows) == len(ROWS)
    ten = next(r for r in rows if r["doc_id"] == 10)
    assert (ten["n_email"], ten["n_phone"]) == (1, 1) and ten["spans"].startswith("phone:5:22,email:31:")
    assert pii.redact(docs).filter("doc_id = 10").first()["text"] == "Call [PHONE] or mail [EMAIL] now"
    assert pii.redact(docs).columns == docs.columns


def test_classifiers_on_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) as toxic")
    w = quality.train(docs, labels)
    scores = quality.score(docs, w).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.keep(docs, w, 0.0).columns == docs.columns and quality.keep(docs, w, 0.0).count() == len(ROWS)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}


def test_maximal_segments():
    def split(v, a, b):
        best = max(((sum(v[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        return [] if best[0] <= 0 else [*split(v, a, best[2]), (best[0], best[2], best[3]), *split(v, best[3], b)]

    rng = random.Random(2)
    for _ in range(300):
        v = [rng.choice([-2, -1, -0.5, 1, 1.5, 2]) for _ in range(rng.randrange(20))]
        assert sorted(s for s, *_ in toxicity.segments(v)) == sorted(s for s, *_ in split(v, 0, len(v)))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert packing.pack(none, WORDS, 2).count() == 0
    assert byte_bpe.round_trip(none, RANKS, pt.PATTERN).count() == 0
    assert token_files.read_tokens(spark, token_files.write_tokens(none, WORDS, 2)).count() == 0
    assert pii.find(none).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.train(none, labels).sum() == 0
