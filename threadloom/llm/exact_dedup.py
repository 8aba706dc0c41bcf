"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Senders: every scan task cuts its rows into blocks and keeps, per block and owner, the sorted
   distinct 48-bit fingerprints of the normalised texts as a Golomb code, beside the packed row
   ids and digests.  Each block names a fingerprint once, however often it occurs there, so a hot
   text costs an owner one code word per block.  The blocks are written to the shared folder.
2. Owners: each owner of a fingerprint range gets the codes of its range alone, decodes them and
   answers every block with a bitmap of the fingerprints that other blocks hold too.
3. Suspects (answered, or repeated inside their block) are verified: bitmaps of their places in the
   input's files let the next scan pick them, and only their texts are shuffled and compared in full
   bytes.  All other rows are final without moving their text.

Equal means identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; a null text is
empty.  A null doc_id orders last and is kept as it is.  If rows repeat text and doc_id, one of
them is kept.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILE, ROW, discard, is_scan, located, place_marks, placed, plan_bytes, shuffle_parts, stash, text_of

FP_BITS = 48
#: Rows of a sender's block at most.
BLOCK_ROWS = 262_144
#: Bytes of input for each owner beyond the session's shuffle partitions.
OWNER_BYTES = 16 << 30
SPACE = "[\\x20\\x09-\\x0D]+"

_BLOCK = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("owner", T.IntegerType()),
        T.StructField("code", T.BinaryType()),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("digests", T.ArrayType(T.BinaryType())),
        T.StructField("files", T.ArrayType(T.LongType())),
        T.StructField("rows", T.ArrayType(T.LongType())),
    ]
)
_CLASS = "block long, digest binary, ids array<bigint>, files array<bigint>, rows array<bigint>, suspect boolean"


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative values below 2**63 as Golomb codes of their gaps, the
    parameter a power of two near 0.69 of the mean gap; unary and binary parts lie apart so that
    numpy codes each in one step."""
    n = len(values)
    if not n:
        return struct.pack("<IBI", 0, 0, 0)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = max(1.0, 0.69 * float(values[-1]) / n)
    k = int(np.log2(mean))
    quotient = gaps >> np.uint64(k)
    ends = np.cumsum(quotient + np.uint64(1)).astype(np.int64)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    unary = np.packbits(unary).tobytes()
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return struct.pack("<IBI", n, k, len(unary)) + unary + np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<IBI", code)
    if not n:
        return np.empty(0, np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 9)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code, np.uint8, offset=9 + size), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= low[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps).astype(np.int64)


def _send(owners: int):
    width = -(-(1 << FP_BITS) // owners)
    schema = pa.schema(
        [("block", pa.int64()), ("owner", pa.int32()), ("code", pa.binary()), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("files", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, t in enumerate(blocks(batches)):
            t = t.sort_by("fp").combine_chunks()
            fp = t["fp"].to_numpy()
            lists = [t[c].chunk(0) for c in ("doc_id", "digest", "file", "row")]
            distinct, first = np.unique(fp, return_index=True)
            counts = np.diff(first, append=len(fp)).astype(np.int32)
            owner = distinct // width
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(distinct)], strict=True):
                lo = first[a]
                hi = first[b] if b < len(distinct) else len(fp)
                out.append((int(owner[a]), golomb_encode(distinct[a:b] - owner[a] * width), counts[a:b], lo, hi))
            starts = np.array([x[3] for x in out] + [len(fp)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 24 | seq] * len(out), pa.int64()),
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([x[1] for x in out], pa.binary()),
                    pa.array([x[2] for x in out], pa.list_(pa.int32())),
                    *[pa.ListArray.from_arrays(starts, x) for x in lists],
                ],
                schema=schema,
            )

    return send


def _answer(t: pa.Table) -> pa.Table:
    """The owner's part: bit i of a block's bitmap says that its i-th fingerprint is elsewhere too."""
    codes = [golomb_decode(c.as_py()) for c in t["code"]]
    values, n = np.unique(np.concatenate(codes), return_counts=True)
    shared = values[n > 1]
    bitmaps = [np.packbits(np.isin(c, shared, assume_unique=True)).tobytes() for c in codes]
    return pa.table({"block": t["block"], "owner": t["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their bitmaps to one row for each block and text digest."""
    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.slice(row, 1)
            counts = r["counts"].flatten().to_numpy()
            digests, *lists = (r[c].flatten() for c in ("digests", "ids", "files", "rows"))
            bits = np.unpackbits(np.frombuffer(r["bitmap"][0].as_py(), np.uint8), count=len(counts)) == 1
            suspect = np.repeat(bits | (counts > 1), counts)
            block = r["block"][0].as_py()
            single = pa.array(np.flatnonzero(~suspect))
            yield _classes(block, digests.take(single), np.arange(len(single) + 1), [x.take(single) for x in lists], False)
            many = np.flatnonzero(suspect)
            if len(many):
                d = digests.take(pa.array(many))
                order = pa.compute.sort_indices(d)
                d, lists = d.take(order), [x.take(pa.array(many)).take(order) for x in lists]
                new = np.flatnonzero(np.concatenate([[True], pa.compute.not_equal(d[1:], d[:-1]).to_numpy(zero_copy_only=False)]))
                yield _classes(block, d.take(pa.array(new)), np.append(new, len(d)), lists, True)


def _classes(block: int, digests: pa.Array, starts: np.ndarray, lists: list[pa.Array], suspect: bool) -> pa.RecordBatch:
    n = len(digests)
    made = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), digests, *made, pa.array(np.full(n, suspect))], names=["block", "digest", "ids", "files", "rows", "suspect"])


def _classify(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, FILE, ROW) for every row; places of rows without copies are null."""
    spark = docs.sparkSession
    found = located(docs)
    rows = found.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    owners = max(shuffle_parts(spark), -(-plan_bytes(docs) // OWNER_BYTES))
    prints = rows.select(
        "doc_id",
        F.expr(f"xxhash64(norm) & {(1 << FP_BITS) - 1}L").alias("fp"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        "file",
        "row",
    )
    blocks = stash(prints.mapInArrow(_send(owners), _BLOCK), "blocks")
    answers = blocks.select("block", "owner", "code").groupBy("owner").applyInArrow(_answer, "block long, owner int, bitmap binary")
    classes = stash(blocks.drop("code").join(answers, ["block", "owner"]).mapInArrow(_receive, _CLASS), "classes")
    discard(blocks)

    none = F.lit(None).cast("long")
    single = classes.filter(~F.col("suspect")).select(F.col("ids")[0].alias("doc_id"), "digest")
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", none.alias(FILE), none.alias(ROW))

    suspects = classes.filter("suspect")
    least = F.array_min("ids")
    groups = (
        suspects.groupBy("digest")
        .agg(F.min(F.struct(least.isNull().alias("none"), least.alias("id"), "block")).alias("keep"), F.sum(F.size("ids")).cast("long").alias("group_size"))
        .select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.block").alias("keep_block"), "group_size")
    )
    picked = placed(place_marks(suspects.select(F.explode(F.arrays_zip("files", "rows")).alias("p")).select(F.col("p.files").alias(FILE), F.col("p.rows").alias(ROW))))
    # Whole texts are the grouping key here: bytes are compared, and a hot text is summed up before it moves.
    verified = (
        found.filter(picked)
        .groupBy(F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"))
        .agg(F.count("*").alias("n"))
        .groupBy(F.unhex(F.sha2("norm", 256)).alias("digest"))
        .agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    )
    sound = F.when((F.col("texts") == 1) & (F.col("n") == F.col("group_size")), F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one digest differ, or the input changed between reads")))
    groups = groups.join(verified, "digest").select("digest", "keep_id", "keep_block", sound.cast("long").alias("group_size"))
    pos = F.coalesce(F.array_position("ids", F.col("keep_id")).cast("int") - 1, F.lit(0))
    copies = (
        suspects.join(groups, "digest")
        .select("digest", "keep_id", "group_size", F.when(F.col("block") == F.col("keep_block"), pos).otherwise(-1).alias("keep_at"), F.posexplode(F.arrays_zip("ids", "files", "rows")).alias("at", "p"))
        .select(F.col("p.ids").alias("doc_id"), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "digest", F.col("p.files").alias(FILE), F.col("p.rows").alias(ROW))
    )
    return single.unionByName(copies)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    return _classify(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies; columns as they are.  Dropped rows are meant by their places, so the
    last pass is a scan with a filter and shuffles nothing."""
    docs = docs if is_scan(docs) else stash(docs, "rows")
    dropped = place_marks(_classify(docs, id_col, text_col).filter("not kept").select(FILE, ROW))
    return located(docs).filter(~placed(dropped)).select(docs.columns)
