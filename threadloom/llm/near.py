"""Near copies by Jaccard similarity of five-word sets: SimHash neighbours first, then a prefix index
for all that fingerprints miss; every meeting is verified by whole sets.

Words are those of ``simhash``; a text's set is that of its runs of ``words`` words (the whole sequence if
shorter) as XXH64 numbers.  Two texts link if their sets share 0.8 of their union, and texts of
equal sets, wordless ones among them, are one node.

Sets in one order over all shingles: two that link share one of the first ``n - ceil(0.8 n) + 1``.  These
prefixes are the index, so no pair is missed.  The order has the shingles last that are often found in one
document of ``EVERY``, by a filter of fixed size: another filter costs work, never a link.

Three rounds of candidates, each followed by components, so that later rounds only meet what is
still apart: (1) fingerprints within two bits, by the deletion-variant index, and each node with the pivot
that it shares most keys with; (2) each node with both pivots of its keys; (3) members of one key.
A candidate must pass, in this order: the sizes and the places of the shared shingle, a bound on the overlap
from two bitmaps of the sets (never too low), and the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, bit_field, claim, discard, id_filter, is_scan, located, place_marks, placed, slices, stash
from .components import components
from .simhash import hashes, links, sign

#: One document of so many is searched for frequent shingles; those found ``LEAST`` times or more go last.
EVERY, LEAST = 8, 4
#: Bits of the filter that names them, and entries that it takes at most, the most frequent ones first.
OFTEN_BITS, OFTEN = 1 << 25, 1 << 21
#: Pairs of a node that meet in one task.
SLICE = 512


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set as rising signed numbers; empty if there is no word."""
    return np.unique(hashes(text, words).view(np.int64))


def _node(own: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _bitmap(own: np.ndarray) -> bytes:
    """Which of four to eight times as many places the set's numbers take."""
    size = 64
    while size < 4 * len(own):
        size <<= 1
    bits = np.zeros(size, np.uint8)
    bits[own & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(n: int, a: bytes, m: int, b: bytes) -> int:
    """Numbers that sets of ``n`` and ``m`` with these bitmaps share at most: a place that one takes and the
    other doesn't holds a number of its own.  The larger bitmap is folded to the smaller one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _often(docs: DataFrame, words: int) -> np.ndarray:
    """A bit field of ``OFTEN_BITS`` of the shingles found often; their numbers are hashes, so two of their parts are the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near")
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, words) for t in b["text"].to_pylist()]))], names=["key"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0).mapInArrow(run, "key long")
    found = stash(some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST), "often")
    least = LEAST
    while found.filter(F.col("n") >= least).count() > OFTEN:
        least *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(OFTEN_BITS - 1)) for s in (0, 32)]))
    words_of = found.filter(F.col("n") >= least).select(at.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("v"))
    return bit_field(words_of, OFTEN_BITS)


def _is_often(own: np.ndarray, field: np.ndarray) -> np.ndarray:
    out = np.ones(len(own), bool)
    for s in (0, 32):
        p = own >> s & (OFTEN_BITS - 1)
        out &= field[p >> 5] >> (p & 31).astype(np.uint32) & 1 == 1
    return out


_ROWS = f"doc_id long, `{FILE}` long, `{ROW}` long, node long, seal long, n int, fp long, bits binary, prefix array<bigint>"


def _prefixes(docs: DataFrame, words: int) -> DataFrame:
    """``_ROWS`` of each row of a located frame; node and seal are two hashes of the set, n is its size."""
    often = docs.sparkSession.sparkContext.broadcast(_often(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = often.value
        claim("near")
        for b in slices(batches):
            marks, prints, sizes, bits, prefixes = [], [], [], [], []
            for t in b["text"].to_pylist():
                all_of = hashes(t, words)
                own = np.unique(all_of.view(np.int64))
                n = len(own)
                marks.append(_node(own))
                prints.append(sign(all_of))
                sizes.append(n)
                bits.append(_bitmap(own))
                prefixes.append(own[np.argsort(_is_often(own, field), kind="stable")[: n - (4 * n + 4) // 5 + 1]])
            marks = np.array(marks, np.int64).reshape(-1, 2)
            cols = [b["doc_id"], b[FILE], b[ROW], pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", FILE, ROW, "node", "seal", "n", "fp", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", FILE, ROW).mapInArrow(run, _ROWS)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sets = [shingles(t, words) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s)[0] for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])

    return docs.select("text").mapInArrow(run, "node long, own array<bigint>")


def _may(n: str, pos: str, m: str, at: str) -> Column:
    """Sizes ``n`` and ``m`` allow 0.8, and so do the shingles left from a first shared one at ``pos`` and ``at``."""
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and 9 * least({n} - {pos}, {m} - {at}) >= 4 * ({n} + {m})")


def _beside(pairs: DataFrame, side: str, values: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``values(node, ...)`` for the node in ``side``; one that many pairs name meets them in slices."""
    last = pairs.groupBy(side).agg(F.expr(f"cast(count(*) div {SLICE} as int)").alias("last"))
    dealt = pairs.join(last, side).withColumn("slice", F.pmod(F.xxhash64("u", "v"), F.col("last") + 1).cast("int")).drop("last")
    own = values.withColumnRenamed("node", side).join(last, side).withColumn("slice", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    return dealt.join(own, [side, "slice"]).drop("slice")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs(u, v)`` whose bitmaps don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            rows = zip(*(b[c].to_pylist() for c in ("n_u", "bits_u", "n_v", "bits_v")), strict=True)
            yield b.select(["u", "v"]).filter(pa.array([9 * overlap_bound(n, x, m, y) >= 4 * (n + m) for n, x, m, y in rows], pa.bool_()))

    for side in "uv":
        pairs = _beside(pairs, side, nodes.select("node", F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")))
    return pairs.select("u", "v", "n_u", "bits_u", "n_v", "bits_v").mapInArrow(run, "u long, v long")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``pairs(u, v)`` whose whole sets link; of each node that they name, one text is read into its set."""
    pairs = stash(_bounded(pairs, nodes), "bounded")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    places = nodes.join(needed, "node").select("place.*")
    # Written between, so that a task has one Python worker at a time.
    texts = stash(located(docs).filter(placed(place_marks(places))).select("text"), "texts")
    sets = stash(_sets(texts, words), "sets")
    discard(texts)
    for side in "uv":
        pairs = _beside(pairs, side, sets.withColumnRenamed("own", f"own_{side}"))
    out = stash(pairs.filter("9 * size(array_intersect(own_u, own_v)) >= 4 * (size(own_u) + size(own_v))").select("u", "v"), "links")
    discard(sets)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` in different components."""
    for side in "uv":
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.filter("root_u <> root_v").select("u", "v")


def _pairs(index: DataFrame, met: DataFrame, wanted: str) -> DataFrame:
    return index.join(met, "key").filter(wanted).filter(_may("n", "pos", "pn", "ppos"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct()


def near_groups(docs: DataFrame, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node, FILE, ROW) of each row, (node, root) of nodes in components of two or more); ``docs`` is a scan."""
    rows = stash(_prefixes(located(docs), words), "prefixes")
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp"), F.min(F.struct(FILE, ROW)).alias("place"), F.min("seal").alias("a"), F.max("seal").alias("b"))
    nodes = stash(nodes, "nodes")
    if not nodes.filter("a <> b").isEmpty():
        raise ValueError("sets of one hash differ")

    # Fingerprints within two bits, by one node for each; nodes of one fingerprint meet the least of them.
    prints = stash(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    close = stash(links(prints.select("fp")), "close")
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    alike = close.join(of("u"), "u").join(of("v"), "v").select(F.col("u_node").alias("a"), F.col("v_node").alias("b"))
    alike = alike.union(nodes.select("node", "fp").join(prints, "fp").select("node", "least"))

    index = rows.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    shared = stash(index.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"), "keys")
    maybe, _ = id_filter(shared, "key")
    index = stash(index.filter(maybe).dropDuplicates(["node", "key"]), "index")
    # A pivot is the member whose keys are shared most: the least edited of near copies, which most of them link to;
    # a second one is the member of the least hash.
    times = index.groupBy("key").agg(F.count("*").alias("times"))
    middle = index.join(times, "key").groupBy("node").agg((F.sum("times") / F.first("n")).alias("middle"))
    index = stash(index.join(middle, "node"), "members")
    me = F.struct("middle", "node", "n", "pos")
    pivots = index.groupBy("key").agg(F.max(me).alias("a"), F.min_by(me, F.xxhash64("node", "key")).alias("b"), F.min("node").alias("least"), F.max("node").alias("most"))
    pivots = pivots.filter("least <> most").select("key", F.explode(F.array("a", "b")).alias("p")).distinct()
    pivots = stash(pivots.select("key", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("node", "n", "pos", "middle")]), "pivots")
    met = stash(_pairs(index, pivots, "node <> pnode").groupBy("node", "pnode").agg(F.count("*").alias("keys"), F.max("pmiddle").alias("middle")), "met")
    best = met.groupBy("node").agg(F.max_by("pnode", F.struct("keys", "middle", "pnode")).alias("pnode"))

    tried = stash(_ordered(alike.union(best), "a", "b"), "pairs")
    sure = _verified(docs, nodes, tried, words)
    roots = stash(components(sure), "roots")

    more = stash(_apart(_ordered(met, "node", "pnode").join(tried, ["u", "v"], "left_anti"), roots), "pairs")
    if not more.isEmpty():
        sure = sure.union(_verified(docs, nodes, more, words))
        roots = stash(components(sure), "roots")
        tried = tried.union(more)

    named = stash(index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    apart = stash(named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key"), "apart")
    if not apart.isEmpty():
        held = stash(named.join(apart, "key", "left_semi"), "held")
        last = _ordered(_pairs(held, held.select("key", *[F.col(c).alias(f"p{c}") for c in ("node", "n", "pos", "root")]), "node < pnode and root <> proot"), "node", "pnode")
        last = stash(last.join(tried, ["u", "v"], "left_anti"), "pairs")
        if not last.isEmpty():
            roots = stash(components(sure.union(_verified(docs, nodes, last, words))), "roots")
    discard(nodes, shared, index, pivots, met, named)
    return rows.select("doc_id", "node", FILE, ROW), roots


def drop_near(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row, one of the least doc_id, of each component; rows with a null doc_id stay.
    Dropped rows are meant by their places, so the last pass is a scan with a filter."""
    docs = docs if is_scan(docs) else stash(docs, "rows")
    rows, roots = near_groups(docs, words)
    rows = stash(rows.filter("doc_id is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rows")
    me = F.struct("doc_id", FILE, ROW)
    groups = stash(rows.groupBy("root").agg(F.min(me).alias("keep"), F.count("*").alias("size")).filter("size > 1").drop("size"), "groups")
    dropped = place_marks(rows.join(groups, "root").filter(me != F.col("keep")).select(FILE, ROW))
    return located(docs).filter(~placed(dropped)).select(docs.columns)
