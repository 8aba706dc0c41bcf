"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``, and are dealt by range of their nearest pivot (a bounded
sample of the vectors) into groups of up to ``GROUP`` documents; a group's blocks of ``BLOCK`` documents
have the largest and smallest value of every term (component).  A query's bound for a block, or for a
whole group, is the sum over its terms of what it can give at most.

1. Each query visits the group of its highest bound and leaves with its k-th best score there, its floor.
2. It then visits the other groups whose bound reaches that floor, and no others.

In a group a query takes blocks by falling bound until bounds fall below its k-th best.  A block is scored
through its forward index, the query's weightiest terms first; a document is left as soon as its partial sum
and the bound of the terms to come, the lesser of the block's summed term maxima and of the product
of norms, fall below the k-th best.  Bounds that equal it count on, for a smaller vec_id may tie.

Queries of one group are cut into slices of ``SLICE``, so a group that all visit is several small tasks.
Group bounds are broadcast in parts of ``DIRECTORY`` bytes, one pass over the queries each.

Ties go to the smaller vec_id.  Vectors that are null, empty or hold null or non-finite components, also
once multiplied by ``scale``, take no part, nor do rows without vec_id.  A query is scored against
vectors of its own length only.  Rows with the query's vec_id are its own; of several such rows the least
vector asks.  Scores beyond 64 bits rank by their exact value and show as the greatest or least long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, slices, stash

GROUP, BLOCK = 8192, 64
#: Queries that meet a group in one task, and bytes of group bounds that are broadcast at once.
SLICE, DIRECTORY = 4096, 32 << 20
#: Pivots at most, and terms that a document is scored by at first and then at each step.
PIVOTS, FIRST, STEP = 256, 16, 8
#: Components below this are stored in two bytes and summed exactly in floating point.
NARROW = 1 << 15
_EDGE = 1 << 63
_FOUND = "query_id long, vec_id long, score long, beyond string"


def integers(values: np.ndarray) -> np.ndarray:
    """Whole floating-point numbers as exact integers: int64 where they fit, Python's own else."""
    if not values.size or np.abs(values).max() < 2**62:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**63 and a.dtype != object and b.dtype != object:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What each query can score at most where terms lie between ``least`` and ``most``, never too low."""
    with np.errstate(over="ignore", invalid="ignore"):
        pos = np.maximum(queries, 0).astype(np.float64) @ most.astype(np.float64).T
        neg = np.minimum(queries, 0).astype(np.float64) @ least.astype(np.float64).T
        out = pos + neg
        out += 1e-9 * (np.abs(pos) + np.abs(neg)) + 1e-3
    return np.where(np.isnan(out), np.inf, out)


class Group:
    """A group's documents by nearest pivot of their own, cut into blocks with term maxima and minima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        f = vectors.astype(np.float64)
        if len(ids) <= BLOCK:
            order = np.argsort(ids, kind="stable")
        else:
            pivots = f[::BLOCK]
            with np.errstate(over="ignore", invalid="ignore"):
                near = ((pivots * pivots).sum(1) - 2 * f @ pivots.T).argmin(1)
            order = np.lexsort((ids, near))
        self.ids, self.vectors, f = ids[order], vectors[order], f[order]
        self.cuts = np.arange(0, len(ids), BLOCK)
        self.most, self.least = np.maximum.reduceat(f, self.cuts), np.minimum.reduceat(f, self.cuts)
        self.narrow = int(np.abs(vectors).max(initial=0)) < NARROW
        if self.narrow:
            self.terms = np.ascontiguousarray(f.T)  # the forward index, by term
            self.norms, self.spread = (f * f).sum(1), f.var(0)

    def documents(self, blocks: np.ndarray) -> np.ndarray:
        at = (self.cuts[blocks][:, None] + np.arange(BLOCK)).ravel()
        return at[at < len(self.ids)]


class Found:
    """The k best so far: (score, vec_id) by falling score and rising id; ``floor`` is the k-th score or one known before."""

    def __init__(self, k: int, own: int, floor: float):
        self.k, self.own, self.floor = k, own, floor
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.own
        ids, scores = np.concatenate([self.ids, ids[other]]), np.concatenate([self.scores, scores[other]])
        if len(ids) > self.k:
            best = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[best], scores[best]
        self.ids, self.scores = ids, scores
        if len(ids) == self.k:
            self.floor = max(self.floor, float(min(scores)) * (1 - 1e-12 if min(scores) > 0 else 1 + 1e-12))


def _visit(q: np.ndarray, g: Group, found: Found, stats: dict | None) -> None:
    """Blocks by falling bound, each through its forward index; for narrow vectors and queries."""
    d = len(q)
    order = np.argsort(-(q * q * g.spread), kind="stable")
    w = q[order]
    gain = np.maximum(w[:, None] * g.most.T[order], w[:, None] * g.least.T[order])
    to_come = np.zeros((d + 1, len(g.cuts)))  # by terms done: what a block's terms to come give at most
    to_come[:d] = np.cumsum(gain[::-1], axis=0)[::-1]
    tail = np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0.0)) * (1 + 1e-12)
    visit = np.argsort(-to_come[0], kind="stable")
    at, wave = 0, max(4, -(-4 * found.k // BLOCK))
    while at < len(visit):
        blocks = visit[at : at + wave]
        at, wave = at + wave, wave if found.floor == -np.inf else 4 * wave
        blocks = blocks[to_come[0][blocks] >= found.floor]
        if not len(blocks):
            break
        docs = g.documents(np.sort(blocks))
        score, square, done = np.zeros(len(docs)), g.norms[docs], 0
        while done < d and len(docs):
            step = d if found.floor == -np.inf else min(d, FIRST if not done else done + STEP)
            part = g.terms.take(order[done:step], 0)
            part = part if len(docs) == len(g.ids) else part.take(docs, 1)
            score = score + w[done:step] @ part
            if stats is not None:
                stats["terms"] = stats.get("terms", 0) + part.size
            done = step
            if done < d:
                square = square - np.einsum("ij,ij->j", part, part)
                rest = np.minimum(np.sqrt(np.maximum(square, 0)) * tail[done] + 1e-3, to_come[done][docs // BLOCK])
                alive = np.flatnonzero(score + rest >= found.floor)
                docs, score, square = docs[alive], score[alive], square[alive]
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + len(docs)
        found.add(g.ids[docs], score.astype(np.int64))


def search(q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, g: Group, k: int, stats: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vec_ids, scores) of the k best of a group, or of those that reach the query's floor.

    ``stats`` counts ``scored`` (documents scored by all terms), ``terms`` (terms added) and ``pairs``."""
    narrow = np.abs(queries).max(axis=1, initial=0) < NARROW if g.narrow else np.zeros(len(q_ids), bool)
    for q_id, q, floor, fast in zip(q_ids.tolist(), queries, floors.tolist(), narrow.tolist(), strict=True):
        found = Found(k, q_id, floor)
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + len(g.ids)
        if fast:
            _visit(q.astype(np.float64), g, found, stats)
        else:
            bounds = _bounds(q[None], g.most, g.least)[0]
            for b in np.argsort(-bounds, kind="stable"):
                if bounds[b] < found.floor:
                    break
                docs = g.documents(np.array([b]))
                found.add(g.ids[docs], dot(q[None], g.vectors[docs])[0])
        if len(found.ids):
            yield q_id, found.ids, found.scores


def _beyond(s: int) -> str | None:
    """A text that orders scores beyond 64 bits among their like, rising with the score."""
    if -_EDGE < s < _EDGE - 1:
        return None
    digits = str(abs(s))
    return f"{len(digits):05d}{digits}" if s > 0 else f"{99_999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


def _results(out: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    rows = [(q, v, s) for q, ids, scores in out for v, s in zip(ids.tolist(), map(int, scores), strict=True)]
    q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    clipped = [min(_EDGE - 1, max(-_EDGE, x)) for x in s]
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(clipped, pa.int64()), "beyond": pa.array([_beyond(x) for x in s], pa.string())})


def _lists(batches, scale: int):
    """(ids, vectors as whole floating-point numbers) of each length in slices of batches; unfit rows are left out."""
    for b in slices(batches, 2048):
        ids, lists = b["vec_id"].to_numpy(), b["embedding"]
        lengths = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            with np.errstate(over="ignore"):
                x = np.floor(scale * flat[starts[at][:, None] + np.arange(dim)])
            fine = np.isfinite(x).all(axis=1)
            if fine.any():
                yield ids[at[fine]], x[fine]


def _bytes(x: np.ndarray) -> list[bytes]:
    """Each row in two bytes a component where all of the rows allow it, in eight else."""
    kind = np.int16 if np.abs(x).max(initial=0) < NARROW else np.float64
    return [r.tobytes() for r in x.astype(kind)]


def _one(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * dim else np.float64).astype(np.float64)


_VECTOR = "vec_id long, dim int, wide boolean, pivot int, vector binary"
_VECTOR_NAMES = ["vec_id", "dim", "wide", "pivot", "vector"]


def _vectors(rows: DataFrame, scale: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``_VECTOR`` of sound rows; the pivot is the nearest of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _lists(batches, scale):
            near = np.zeros(len(ids), np.int32)
            if (p := pivots.get(x.shape[1])) is not None:
                with np.errstate(over="ignore", invalid="ignore"):
                    near = ((p * p).sum(1) - 2 * x @ p.T).argmin(1).astype(np.int32)
            wide = np.abs(x).max(axis=1) >= NARROW
            for w in (False, True):
                at = np.flatnonzero(wide == w)
                if len(at):
                    cols = [pa.array(ids[at]), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(np.full(len(at), w)), pa.array(near[at]), pa.array(_bytes(x[at]), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=_VECTOR_NAMES)

    return rows.mapInArrow(run, _VECTOR)


_GROUP = "g long, dim int, wide boolean, ids binary, vectors binary, most binary, least binary"
_GROUP_NAMES = ["g", "dim", "wide", "ids", "vectors", "most", "least"]


def _pack(most: int):
    """Vectors in order to rows of up to ``most`` of one length and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 24
        held, size, key = [], 0, None

        def row() -> pa.RecordBatch:
            nonlocal seq, held, size
            ids = np.concatenate([i for i, _ in held]).astype(np.int64)
            data = b"".join(d for _, ds in held for d in ds)
            dim, wide = key
            x = np.frombuffer(data, np.float64 if wide else np.int16).reshape(-1, dim)
            bounds = [getattr(x, m)(axis=0).astype(np.float64).tobytes() for m in ("max", "min")]
            cols = [[seq], [dim], [wide], [ids.tobytes()], [data], *[[b] for b in bounds]]
            seq, held, size = seq + 1, [], 0
            kinds = (pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_GROUP_NAMES)

        for b in slices(batches, 2048):
            dims, wides = b["dim"].to_numpy(), b["wide"].to_numpy(zero_copy_only=False)
            ids, data = b["vec_id"].to_numpy(), b["vector"].to_pylist()
            new = np.flatnonzero((np.diff(dims) != 0) | (np.diff(wides.astype(np.int8)) != 0)) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), len(ids)], strict=True):
                if held and key != (int(dims[a]), bool(wides[a])):
                    yield row()
                key = int(dims[a]), bool(wides[a])
                while a < z:
                    take = min(z - a, most - size)
                    held.append((ids[a : a + take], data[a : a + take]))
                    a, size = a + take, size + take
                    if size == most:
                        yield row()
        if held:
            yield row()

    return run


def _directory(groups: DataFrame) -> list:
    """Broadcasts of {length: (groups, most, least)}, each of ``DIRECTORY`` bytes or a little more."""
    size = groups.agg(F.coalesce(F.sum(16 * F.col("dim")), F.lit(0))).first()[0]
    parts = 1 + size // DIRECTORY
    out = []
    for part in range(parts):
        rows = groups.filter(F.pmod(F.xxhash64("g"), F.lit(parts)) == part).select("g", "dim", "most", "least").collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["dim"], []).append(r)
        known = {d: (np.array([r["g"] for r in rs]), *[np.array([np.frombuffer(r[c]) for r in rs]) for c in ("most", "least")]) for d, rs in by.items()}
        out.append(groups.sparkSession.sparkContext.broadcast(known))
    return out


_ASK = "query_id long, dim int, q binary, floor double, g long, bound double"
_ASK_NAMES = ["query_id", "dim", "q", "floor", "g", "bound"]


def _ways(asked: DataFrame, directory, first: bool) -> DataFrame:
    """Each query with the group of its highest bound in this part, or with all others that reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = directory.value
        for b in slices(batches, 512):
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in known:
                    continue
                groups, most, least = known[dim]
                at = np.flatnonzero(dims == dim)
                rows = b.take(pa.array(at))
                bounds = _bounds(np.array([_one(v.as_py(), dim) for v in rows["q"]]), most, least)
                if first:
                    i, j = np.arange(len(at)), bounds.argmax(1)
                else:
                    floor = rows["floor"].to_numpy(zero_copy_only=False)
                    i, j = np.nonzero((bounds >= floor[:, None]) & (groups[None, :] != rows["g"].to_numpy(zero_copy_only=False)[:, None]))
                for s in range(0, len(i), 4096):
                    own = rows.take(pa.array(i[s : s + 4096]))
                    cols = [own["query_id"], own["dim"], own["q"], own["floor"], pa.array(groups[j[s : s + 4096]]), pa.array(bounds[i[s : s + 4096], j[s : s + 4096]])]
                    yield pa.RecordBatch.from_arrays(cols, names=_ASK_NAMES)

    return asked.mapInArrow(run, _ASK)


def _meet(asks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Results of each query in the group it is sent to; a group's queries meet it in slices."""
    times = asks.groupBy("g").agg(F.count("*").alias("n")).select("g", F.expr(f"n div {SLICE}").cast("int").alias("last"))
    left = groups.join(times, "g").select("g", F.explode(F.sequence(F.lit(0), "last")).alias("slice"), "dim", "wide", "ids", "vectors")
    right = asks.join(times, "g").select("g", F.pmod(F.xxhash64("query_id"), F.col("last") + 1).cast("int").alias("slice"), "query_id", "q", "floor")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _results([])
        dim, wide = a["dim"][0].as_py(), a["wide"][0].as_py()
        x = np.frombuffer(a["vectors"][0].as_py(), np.float64 if wide else np.int16).reshape(-1, dim)
        held = Group(np.frombuffer(a["ids"][0].as_py(), np.int64), integers(x.astype(np.float64)))
        raw = np.array([_one(v.as_py(), dim) for v in b["q"]])
        big = np.abs(raw).max(axis=1) >= NARROW
        out, ids, floors = [], b["query_id"].to_numpy(), b["floor"].to_numpy()
        for some in (np.flatnonzero(~big), np.flatnonzero(big)):
            if len(some):
                out += search(ids[some], integers(raw[some]), floors[some], held, k)
        return _results(out)

    return left.groupBy("g", "slice").cogroup(right.groupBy("g", "slice")).applyInArrow(meet, _FOUND)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors(vec_id, embedding)`` for each row of ``queries``."""
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)

    rows = sound(vectors)
    # Other pivots mean other groups, never other results.
    some: dict[int, list] = {}
    for _, x in _local(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS), scale):
        some.setdefault(len(x), []).append(x)
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = {d: np.array(xs) for d, xs in some.items()}
    dealt = stash(_vectors(rows, scale, pivots), "vectors")
    order = ["dim", "wide", "pivot", F.xxhash64("vec_id")]
    groups = stash(dealt.repartitionByRange(parts_for(dealt, 64), *order).sortWithinPartitions(*order).mapInArrow(_pack(group), _GROUP), "groups")
    directory = _directory(groups)

    least = sound(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stash(_vectors(least, scale, {}).select(F.col("vec_id").alias("query_id"), "dim", F.col("vector").alias("q"), F.lit(float("-inf")).alias("floor"), F.lit(None).cast("long").alias("g")), "asked")
    ways = [_ways(asked, d, True) for d in directory]
    one = ways[0]
    for w in ways[1:]:
        one = one.union(w)
    if len(ways) > 1:
        one = one.groupBy("query_id").agg(F.max_by(F.struct("dim", "q", "floor", "g"), "bound").alias("b")).select("query_id", "b.*")
    one = stash(one.select("query_id", "dim", "q", "floor", "g"), "first")
    near = stash(_meet(one, groups, k), "near")

    held = F.when(F.count("*") >= k, F.min("score").cast("double"))
    floors = near.groupBy("query_id").agg(F.when(F.max(F.abs(F.col("score").cast("double"))) < float(1 << 53), held).alias("known"))
    rest = one.join(floors, "query_id", "left").withColumn("floor", F.coalesce("known", "floor")).drop("known")
    ways = [_ways(rest, d, False) for d in directory]
    two = ways[0]
    for w in ways[1:]:
        two = two.union(w)
    found = near.unionByName(_meet(stash(two, "others"), groups, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _local(rows: DataFrame, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """A bounded frame's (vec_id, whole numbers) in the driver."""
    for r in rows.collect():
        x = np.floor(scale * np.array(r["embedding"], float))
        if np.isfinite(x).all():
            yield r["vec_id"], x
