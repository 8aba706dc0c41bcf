"""Shared plumbing of the training-data operators.

Rows are told by their place: a 64-bit hash of the file's path and the row's number in it, both from the
scan's own metadata.  What an operator decides about rows of a large table becomes one bitmap for each
file and 2**20 rows in the shared folder, and the next scan looks its own rows up there, so
no text is shuffled to meet a decision, whatever the number of rows decided on.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the membership filter at most (8 MiB); see :func:`id_filter`.
FILTER_BITS = 1 << 26
_PROBES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a local one if the executors are, too."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None)
    if at is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="threadloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at := f"file://{local}")
        return shared_dir(spark)
    return at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/threadloom-{spark.sparkContext.applicationId}")
    fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(own)
    fs.deleteOnExit(own)  # the application's folder and all below it
    hpath = jvm.org.apache.hadoop.fs.Path(own, f"{label}-{uuid.uuid4().hex}")
    return fs.makeQualified(hpath).toString()


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder once and read back from there."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._threadloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`stash` wrote for these; nothing that is still to run may read them."""
    for df in frames:
        if path := getattr(df, "_threadloom_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


#: Columns of a row's place; names that no table has.
FILE, ROW = "threadloom file", "threadloom row"
_CHUNK_BITS = 20


def is_scan(docs: DataFrame) -> bool:
    """Whether rows of ``docs`` have places: it is a scan of files, perhaps projected or filtered."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return len(docs.select(docs.metadataColumn("_metadata")["row_index"]).schema) == 1
    except AnalysisException:
        return False


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``FILE`` and ``ROW``.  What isn't a scan of files is written once to become one, so
    a caller who needs the same places twice does that itself."""
    docs = docs if is_scan(docs) else stash(docs, "rows")
    meta = docs.metadataColumn("_metadata")
    return docs.withColumns({FILE: F.xxhash64(meta["file_path"]), ROW: meta["row_index"].cast("long")})


def place_marks(places: DataFrame) -> str:
    """Bitmaps of ``places(FILE, ROW)`` in a new folder, which is returned; see :func:`placed`."""
    folder = scratch(places.sparkSession, "marks")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def write(key: tuple, t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK_BITS, np.uint8)
        bits[t["at"].to_numpy()] = 1
        out = Sink(_mark_file(folder, key[0].as_py(), key[1].as_py()), TaskContext.get().taskAttemptId())
        out.write(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        out.close()
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    rows = places.select(F.col(FILE).alias("file"), F.shiftright(ROW, _CHUNK_BITS).alias("chunk"), F.col(ROW).bitwiseAND((1 << _CHUNK_BITS) - 1).cast("int").alias("at"))
    # A group is one file's run of 2**20 rows: four MB of numbers at most.
    rows.distinct().groupBy("file", "chunk").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def _mark_file(folder: str, file: int, chunk: int) -> str:
    return f"{folder}/{file & (1 << 64) - 1:016x}-{chunk}"


def placed(folder: str) -> Column:
    """Whether a row of a :func:`located` frame is among the marked places."""

    @F.pandas_udf("boolean")
    def look(files: pd.Series, rows: pd.Series) -> pd.Series:
        from pyarrow import fs as pafs

        f, r = files.to_numpy(np.int64), rows.to_numpy(np.int64)
        chunk, out = r >> _CHUNK_BITS, np.zeros(len(f), bool)
        cuts = np.flatnonzero((np.diff(f) != 0) | (np.diff(chunk) != 0)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(f)], strict=True):
            if a == z:
                continue
            uri = _mark_file(folder, int(f[a]), int(chunk[a]))
            if _last_mark.get("uri") != uri:
                store, path = open_fs(uri)
                bits = None
                if store.get_file_info(path).type != pafs.FileType.NotFound:
                    with store.open_input_stream(path, compression=None) as stream:
                        bits = np.frombuffer(zlib.decompress(stream.read()), np.uint8)
                _last_mark.update(uri=uri, bits=bits)
            if (bits := _last_mark["bits"]) is not None:
                at = r[a:z] & ((1 << _CHUNK_BITS) - 1)
                out[a:z] = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return pd.Series(out)

    return look(F.col(FILE), F.col(ROW))


#: The bitmap a worker looked at last.
_last_mark: dict = {}


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, mb: int) -> int:
    """Partitions of about ``mb`` MiB each, at least as many as the session's shuffles have."""
    return min(1_000_000, max(shuffle_parts(df.sparkSession), -(-plan_bytes(df) // (mb << 20))))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_filter(ids: DataFrame, column: str) -> tuple[Column, int]:
    """A Bloom filter over ``ids[column]``: (predicate on a column of that name, distinct ids at most).

    Its size is ten bits an id and never over :data:`FILTER_BITS`, whatever the number of ids, so
    it is safe to broadcast.  Past that bound it lets more rows pass; callers join exactly
    afterwards, so only work grows, never the result.  Null passes always.
    """
    spark = ids.sparkSession
    n = ids.count()
    bits = 1 << 16
    while bits < min(FILTER_BITS, 10 * n):
        bits <<= 1
    h = F.xxhash64(F.col(column))
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[F.pmod(h + step * j, F.lit(bits)) for j in range(_PROBES)]))
    words = (
        ids.select(at.alias("p"))
        .groupBy(F.shiftright("p", 5).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("v"))
    )
    field = bit_field(words, bits)
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        f, h = shared.value, hashes.to_numpy(np.int64)
        step = (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
        out = np.ones(len(h), bool)
        with np.errstate(over="ignore"):
            for j in range(_PROBES):
                p = (h + step * j) & (bits - 1)
                out &= (f[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
        return pd.Series(out)

    return F.col(column).isNull() | maybe(h), n


def bit_field(words: DataFrame, bits: int) -> np.ndarray:
    """``words(w, v)``, a row for each 32 bits that has any, as one array of ``bits``."""
    rows, field = words.select(F.col("w").cast("long"), "v").toArrow(), np.zeros(bits >> 5, np.uint32)
    field[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint32)
    return field


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder, as Hadoop or Python spells it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class Sink:
    """A file of the shared folder that appears whole or not at all: an attempt writes under a name
    of its own and moves it into place, so retries and speculative copies don't mix."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = open_fs(uri)
        self.own = f"{self.path}.{attempt}.tmp"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


#: Bytes of texts that are Python objects at a time, unless one text alone has more.
SLICE_BYTES = 8 << 20


def slices(batches, rows: int = 512, most: int = SLICE_BYTES):
    """Record batches cut so that only ``rows`` rows, or ``most`` bytes of texts, are Python objects at a time.
    After the last the worker gives back the memory that it no longer uses, as it may idle beside others."""
    for b in batches:
        sizes = [pa.compute.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
        ends = np.cumsum(sum(s.astype(np.int64) for s in sizes)) if sizes else np.zeros(b.num_rows, np.int64)
        at = 0
        while at < b.num_rows:
            held = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, b.num_rows, int(np.searchsorted(ends, held + most, "right"))))
            yield b.slice(at, stop - at)
            at = stop
    tidy()


def tidy() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_memos: dict[str, tuple[dict, ...]] = {}


def claim(name: str, *memos: dict) -> None:
    """One operator's memos at a time in a worker process: those of others are emptied, and the memory goes back."""
    if name not in _memos:
        for held in _memos.values():
            for memo in held:
                memo.clear()
        _memos.clear()
        tidy()
    _memos[name] = memos


def by_text(docs: DataFrame, change, column: str = "text") -> DataFrame:
    """``docs`` through ``change(texts) -> (keep, new texts)``, either of which may be None; rows stay in
    place, other columns as they are, and few texts are Python objects at a time."""
    at = docs.columns.index(column)

    def run(batches):
        step = change()
        for b in slices(batches):
            keep, new = step(b.column(at).to_pylist())
            if new is not None:
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield b if keep is None else b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
