"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments: of two fingerprints that differ in at most two
bits, one segment differs in at most one.  Each distinct fingerprint is indexed by both segments
as they are and with each one bit wiped out; equal keys meet by one shuffle, and every meeting is
verified over all 64 bits.  Copies share a fingerprint, so they enter the index once.

Keys that more than ``RUN`` fingerprints share aren't paired.  Their members go to an index of all
fingerprints one flip away: two of them meet there exactly if they differ in at most two bits, and
everything that meets is linked to the least of it.  Such a meeting has 65 members at most, so
no link is lost and no group is squared.  Components follow by large and small stars.

Texts: A to Z to lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words joined by a
space with repeats (the whole sequence if shorter), XXH64 with seed 42; a bit is set if it is set
in over half of the hashes.  Null and wordless texts have fingerprint zero and are linked like
others.  A null doc_id stays a row but names a component only as null, if all its rows are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, claim, is_scan, located, place_marks, placed, slices, stash
from .components import components

SEED = 42
#: Fingerprints of a key that are paired with each other at most.
RUN = 32
_SHIFT = np.arange(32, dtype=np.uint64)


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)], np.uint64, len(last))


def sign(own: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed 64-bit number; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 14):
        part = own[at : at + (1 << 14)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int) -> int:
    return sign(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp long), with the rows' places if ``docs`` has them."""
    places = [c for c in (FILE, ROW) if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near")
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([fingerprint(t, words) for t in b["text"].to_pylist()], pa.int64()), *[b[c] for c in places]], names=["doc_id", "fp", *places])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *places).mapInArrow(run, "doc_id long, fp long" + "".join(f", `{c}` long" for c in places))


def _pairs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp, pa.int64())], names=["key", "fp"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys: segment (1 bit), wiped bit plus one or zero (6 bits), segment without that bit (32 bits)."""
    for b in slices(batches, 4096):
        fp = b["fp"].to_numpy()
        bits = fp.view(np.uint64)
        for s in (0, 1):
            seg = (bits >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)
            wiped = seg[:, None] & ~(np.uint64(1) << _SHIFT)[None, :] | (_SHIFT + np.uint64(1))[None, :] << np.uint64(32)
            keys = np.concatenate([seg[:, None], wiped], axis=1) | np.uint64(s << 38)
            yield _pairs(keys.astype(np.int64).ravel(), np.repeat(fp, keys.shape[1]))


def _flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flip = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for b in slices(batches, 4096):
        fp = b["fp"].to_numpy()
        yield _pairs((fp.view(np.uint64)[:, None] ^ flip[None, :]).view(np.int64).ravel(), np.repeat(fp, 65))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fp, run starts, run lengths) of whole runs of a sorted stream.  A run longer than ``most``
    may come in parts; each part is marked by a negative length."""
    key, fp, long = np.empty(0, np.int64), np.empty(0, np.int64), None
    for b in _ended(batches):
        if b is not None:
            key, fp = np.concatenate([key, b["key"].to_numpy()]), np.concatenate([fp, b["fp"].to_numpy()])
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(starts, append=len(key))
        keep = len(key)
        if b is not None and lengths[-1] <= most and key[-1] != long:  # the last run may go on
            keep = int(starts[-1])
            starts, lengths = starts[:-1], lengths[:-1]
        if len(starts):
            over = lengths > most
            over[0] |= key[0] == long
            if keep == len(key):
                long = key[-1] if over[-1] else None
            yield key, fp, starts, np.where(over, -lengths, lengths)
        key, fp = key[keep:], fp[keep:]


def _ended(batches):
    yield from batches
    yield None


def _linker(run: int):
    def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verified pairs (u, v) of one key; for a key with too many, (u, null) for each member."""
        for key, fp, starts, lengths in _runs(batches, run):
            us, vs = [], []
            for n in np.unique(lengths[(lengths > 1)]):
                at = starts[lengths == n]
                held = fp[at[:, None] + np.arange(n)].view(np.uint64)
                wiped = key[at] >> 32 & 63
                shift = (np.where(key[at] >> 38 & 1, 32, 0) + np.maximum(wiped - 1, 0)).astype(np.uint64)
                for i in range(n - 1):
                    for j in range(i + 1, n):
                        x = held[:, i] ^ held[:, j]
                        # Pairs whose segments are equal meet at the whole segment, not at each wiped bit too.
                        ok = (np.bitwise_count(x) <= 2) & ((wiped == 0) | (x >> shift & np.uint64(1) == 1))
                        us.append(held[ok, i])
                        vs.append(held[ok, j])
            u = np.concatenate(us).view(np.int64) if us else np.empty(0, np.int64)
            v = np.concatenate(vs).view(np.int64) if us else np.empty(0, np.int64)
            over = lengths < 0
            many = fp[np.concatenate([np.arange(a, a - n) for a, n in zip(starts[over], lengths[over], strict=True)])] if over.any() else np.empty(0, np.int64)
            many = np.unique(many)
            if len(u) + len(many):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([u, many])), pa.array(np.concatenate([v, many]), mask=np.arange(len(u) + len(many)) >= len(u))], names=["u", "v"]
                )

    return _links


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a flip's meeting are all within two bits of each other: link each to the least."""
    for _, fp, starts, lengths in _runs(batches, 1 << 20):
        first = np.repeat(fp[starts], lengths)
        own = fp[starts[0] : starts[0] + len(first)]
        other = own != first
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[other]), pa.array(first[other])], names=["u", "v"])


def links(prints: DataFrame, run: int = RUN) -> DataFrame:
    """(u, v): pairs of distinct fingerprints ``prints(fp)`` at two or fewer differing bits, enough of them
    that all which such pairs connect stay connected."""
    meet = prints.mapInArrow(_variants, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = stash(meet.mapInArrow(_linker(run), "u long, v long"), "links")
    pairs = found.filter("v is not null").distinct()
    crowd = found.filter("v is null").select(F.col("u").alias("fp")).distinct()
    stars = crowd.mapInArrow(_flips, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars, "u long, v long")
    return pairs.union(stars)


def near_groups(docs: DataFrame, words: int = 5, run: int = RUN) -> DataFrame:
    """(doc_id, fp long, component_id): fingerprints link at two or fewer differing bits, and
    component_id is the least doc_id that links reach."""
    prints = stash(fingerprints(docs, words), "fingerprints")
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stash(components(links(distinct.select("fp"), run)), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    names = stash(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    labels = stash(roots.join(names, "root").select(F.col("node").alias("fp"), "component_id"), "labels")
    labelled = distinct.join(labels.withColumn("linked", F.lit(True)), "fp", "left")
    classes = stash(labelled.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", *prints.columns[2:])


def drop_near(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row, one of the least doc_id, of each group; rows with a null doc_id stay.  Dropped
    rows are meant by their places, so the last pass is a scan with a filter."""
    docs = docs if is_scan(docs) else stash(docs, "rows")
    rows = stash(near_groups(located(docs), words).filter("doc_id is not null"), "rows")
    me = F.struct("doc_id", FILE, ROW)
    groups = stash(rows.groupBy("component_id").agg(F.min(me).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "groups")
    dropped = place_marks(rows.join(groups, "component_id").filter(me != F.col("keep")).select(FILE, ROW))
    return located(docs).filter(~placed(dropped)).select(docs.columns)
