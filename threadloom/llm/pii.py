"""Personal data by weak supervision.

Candidates are the contract's spans (``base``) and looser ones: number groups without a plus sign,
card-like numbers of any checksum, written-out addresses.  Labelers of three sorts vote on each
(1 for, 2 against, 0 none): patterns and checksums, gazetteers of words around it, and the
signs beside it.  Expectation-maximisation over the counts of vote patterns, summed over all
documents, estimates how reliable each labeler is for each kind.  Its posteriors train a logistic
span classifier on hashed features (shape, neighbours, votes) from at most ``SAMPLE`` candidates,
the first by a hash of their place; the classifier alone decides about spans that aren't base.
Base spans always stay; an added span never overlaps another of its kind.

Estimates start from few prior counts that never grow, so with the data they go to what the votes say.

Null and empty texts have no spans; repeated rows and null doc_ids are like any others; offsets
are code points, ends exclusive.  Every pattern is linear in the text's length.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, claim, slices, stash

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
DIMS = 1 << 12
LABELERS = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# From inside a digit run nothing matches that doesn't match from its start, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUPS = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{2,24}){1,4}")
_QUADS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")

# Gazetteers: words that go with a kind, endings of hosts, words that speak against numbers.
_NEAR = {
    "email": {"mail", "email", "e-mail", "contact", "correo", "courriel", "write", "address", "kontakt"},
    "ip": {"ip", "host", "server", "address", "client", "login", "from", "addr"},
    "card": {"card", "visa", "credit", "mastercard", "amex", "karte", "tarjeta", "carte", "payment", "paid"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone", "whatsapp", "cell"},
}
_AGAINST = {"version", "release", "isbn", "issn", "doi", "token", "order", "invoice", "sku", "id", "section", "key", "hash", "serial"}
_ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl"}
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, matches of the card pattern that fail) as (start, kind, end), leftmost and non-overlapping by kind."""
    out, failed = [], []
    at, last = text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, last := m.end()))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19:
                (out if luhn(d) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out), failed


def loose_spans(text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates; none overlaps a base span or another candidate."""
    more = [(a, k, b) for a, k, b in failed if b - a >= 13]
    more += [(m.start(), 3, m.end()) for m in _GROUPS.finditer(text)]
    if "at]" in text or "at)" in text:
        more += [(m.start(), 0, m.end()) for m in _WRITTEN.finditer(text)]
    if "[.]" in text:
        more += [(m.start(), 1, m.end()) for m in _QUADS.finditer(text)]
    starts, ends = [], []  # of the base spans' union, in order
    for a, b in sorted((a, b) for a, _, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, last = [], 0
    for a, k, b in sorted(more):
        i = bisect_right(ends, a)
        if a >= last and (i == len(ends) or starts[i] >= b):
            out.append((a, k, b))
            last = b
    return out


def votes(text: str, a: int, kind: int, b: int, base: bool) -> tuple[list[int], list[str]]:
    """The labelers' votes and the words around the span."""
    span, before, after = text[a:b], text[max(0, a - 48) : a], text[b : b + 24]
    d = _digits(span)
    near = [w.lower() for w in _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]]
    v = [0] * LABELERS
    v[0] = 1 if base else 0  # the strict pattern
    if kind == 0:
        v[1] = 1 if re.split(r"[.\])]\s*", span)[-1].lower() in _ENDINGS else 2
        v[5] = 2 if ".." in span or len(span) > 80 else 1
    elif kind == 1:
        parts = re.findall("[0-9]+", span)
        v[1] = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else 2
        v[5] = 2 if any(len(p) > 1 and p[0] == "0" for p in parts) or parts[0] == "0" else 1
    elif kind == 2:
        v[1] = 1 if luhn(d) else 2
        v[5] = 1 if d[0] in "23456" and len(d) in (13, 15, 16) else 2
    else:
        v[1] = 1 if 9 <= len(d) <= 15 else 2
        v[5] = 1 if re.fullmatch(r"(\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{2,4}([\x20.-]?[0-9]{2,4})*", span) else 2
    v[2] = 1 if _NEAR[KINDS[kind]] & set(near) else 0
    v[3] = 2 if _AGAINST & set(near) else 0
    beside = before[-1:] + after[:1]
    v[4] = 2 if any(c.isalnum() or c in "/=#_" for c in beside) else 1
    return v, near


def slots(text: str, a: int, kind: int, b: int, v: list[int], near: list[str]) -> list[int]:
    """Hashed features of a span; slot 0 is the bias."""
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", text[a : min(b, a + 64)]))
    names = [f"{kind}", f"{kind}s{shape}", f"{kind}n{min(b - a, 40) // 4}", *[f"{kind}v{i}{x}" for i, x in enumerate(v)], *[f"{kind}w{w}" for w in near]]
    return [0, *sorted({1 + zlib.crc32(n.encode("utf-8", "surrogatepass")) % (DIMS - 1) for n in names})]


#: Prior counts of the votes none, for and against of a labeler, given that a span is false or true: votes are
#: trusted moderately, the strict pattern most.  They don't grow with the data, which soon outweigh them.
_PRIOR = np.array([[4.0, 1.0, 4.0], [4.0, 4.0, 1.0]])
_STRICT = np.array([[30.0, 0.3, 1.0], [2.0, 30.0, 0.3]])


def estimate(patterns: list[str], n: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each vote pattern, chances of each vote by labeler and truth, share of true spans) of
    one kind by expectation-maximisation over the patterns' counts ``n``, from few prior counts."""
    x = np.array([[int(c) for c in p] for p in patterns])
    prior = np.repeat(_PRIOR[None], LABELERS, 0)  # labeler, truth, vote
    prior[0] = _STRICT
    q = np.where(x[:, 0] == 1, 0.95, 0.3)
    for _ in range(rounds):
        table = prior.copy()
        for i in range(LABELERS):
            for vote in range(3):
                here = x[:, i] == vote
                table[i, 0, vote] += (n * (1 - q))[here].sum()
                table[i, 1, vote] += (n * q)[here].sum()
        table /= table.sum(axis=2, keepdims=True)
        truth = float((n * q).sum() + 1) / float(n.sum() + 2)
        log = np.log(table)[np.arange(LABELERS), :, x].sum(axis=1) + np.log([1 - truth, truth])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return q, table, truth


def reliabilities(counts: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """Posterior of each (kind, votes) pattern from (kind, votes, count)."""
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        patterns, n = zip(*[(p, c) for k, p, c in counts if k == kind], strict=True)
        q, _, _ = estimate(list(patterns), np.array(n, float))
        out |= {(kind, p): float(v) for p, v in zip(patterns, q, strict=True)}
    return out


def classifier(rows: list[tuple[list[int], float]], passes: int = 8, rate: float = 0.5) -> np.ndarray:
    """Logistic weights from soft labels, by adaptive gradient steps in the rows' order."""
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-2)
    for _ in range(passes):
        for at, y in rows:
            at = np.array(at)
            p = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w[at].sum())))))
            g = (p - y) + 1e-4 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w.astype(np.float32)


_FOUND = "doc_id long, spans array<struct<start: int, kind: int, end: int, base: boolean, votes: string, slots: array<int>>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("slots", pa.list_(pa.int32()))]))


def candidates(text: str | None) -> list[dict]:
    if not text:
        return []
    base, failed = base_spans(text)
    out = []
    for spans, sure in ((base, True), (loose_spans(text, base, failed), False)):
        for a, k, b in spans:
            v, near = votes(text, a, k, b, sure)
            out.append({"start": a, "kind": k, "end": b, "base": sure, "votes": "".join(map(str, v)), "slots": slots(text, a, k, b, v, near)})
    return out


def _look(docs: DataFrame) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([candidates(t) for t in b["text"].to_pylist()], _SPAN)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, _FOUND)


def learn(one: DataFrame) -> np.ndarray:
    """The classifier's weights from all candidates, one a row (``doc_id``, ``s``)."""
    counts = one.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()  # at most 4 * 3**6 patterns
    trust = reliabilities([tuple(r) for r in sorted(counts)])
    taken = one.select("s.kind", "s.votes", "s.slots", F.xxhash64("doc_id", "s.start", "s.kind").alias("h")).orderBy("h", "kind", "votes").limit(SAMPLE).collect()
    return classifier([(r["slots"], trust[r["kind"], r["votes"]]) for r in taken])


def _chosen(spans: list[dict], weights: np.ndarray) -> list[dict]:
    kept = [s for s in spans if s["base"] or float(weights[s["slots"]].sum()) > 0]
    return sorted(({k: s[k] for k in ("start", "kind", "end", "base")} for s in kept), key=lambda s: (s["start"], s["kind"]))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; other columns stay and no text is shuffled."""
    spark = docs.sparkSession
    one = stash(_look(docs).select("doc_id", F.explode("spans").alias("s")), "spans")
    weights = spark.sparkContext.broadcast(learn(one))

    def change():
        return lambda texts: (None, [mask(t, _chosen(candidates(t), weights.value)) for t in texts])

    return by_text(docs, change)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end, base>>): base spans and those that the method adds."""
    found = stash(_look(docs), "spans")
    weights = docs.sparkSession.sparkContext.broadcast(learn(found.select("doc_id", F.explode("spans").alias("s"))))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in slices(batches):
            rows = [_chosen(spans, w) for spans in b["spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, kind)], names=["doc_id", "spans"])

    return found.mapInArrow(decide, "doc_id long, spans array<struct<start: int, kind: int, end: int, base: boolean>>")


def _of(kind: int):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what :func:`find` gives; counts are of base spans."""
    base = F.filter("spans", lambda s: s["base"])
    names = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    n = {f"n_{k}": F.size(F.filter(base, _of(i))).cast("long") for i, k in enumerate(KINDS)}
    return found.select("doc_id", *[c.alias(k) for k, c in n.items()], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def mask(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span, or union of overlapping ones, replaced by the kind of its first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
