"""Token ids in files of fixed-width codes, with block offsets for random access.

A file is: blocks of up to ``BLOCK_IDS`` ids, each id in the fewest bits that hold the vocabulary;
then the documents' ids (int64) and null flags, their starts in the file, the blocks' byte
offsets; then a trailer of fixed size.  Any id range is read from the blocks that hold it, and
numpy unpacks a block in one step.

Documents are written in ascending doc_id (null first; equal ids by text) over range-partitioned
shards, and shard totals alone, one row for each file, reach the driver.  Null texts are empty;
an empty document has its end id only; an empty table has no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, open_fs, parts_for, scratch, slices
from .word_ids import MEMO, word_ids

BLOCK_IDS = 1 << 16
_TRAILER = struct.Struct("<QQQIB3x8s")
_MAGIC = b"TLOOMTK1"


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first."""
    if width % 8 == 0:
        return np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if width % 8 == 0:
        out[:, : width // 8] = np.frombuffer(data, np.uint8, n * width // 8).reshape(n, -1)
        return out.view("<u4").ravel()
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


class TokenWriter:
    def __init__(self, sink: Sink, vocabulary: int):
        self.sink, self.width = sink, max(1, (vocabulary - 1).bit_length())
        self.ids, self.starts, self.offsets = [], [0], []
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            self.offsets.append(self.sink.at)
            self.sink.write(pack_bits(ids[at : min(whole, at + BLOCK_IDS)], self.width))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        self.sink.write(np.array([0 if x is None else x for x in self.ids], "<i8").tobytes())
        self.sink.write(np.array([x is None for x in self.ids], np.uint8).tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(_TRAILER.pack(len(self.ids), self.starts[-1], self.sink.at, BLOCK_IDS, self.width, _MAGIC))
        self.sink.close()
        return len(self.ids), self.starts[-1]


class TokenFile:
    """Random access to one file; only its index is held."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n_docs, self.n_ids, tail, self.block, self.width, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        blocks = -(-self.n_ids // self.block) if self.n_ids else 0
        if magic != _MAGIC or tail != size - _TRAILER.size:
            raise ValueError(f"{uri} is no whole token file")
        at = tail - 8 * blocks - 8 * (self.n_docs + 1) - self.n_docs - 8 * self.n_docs
        part = lambda n, kind: np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), kind)
        self.ids = part(self.n_docs, "<i8")
        at += 8 * self.n_docs
        self.null = part(self.n_docs, np.uint8) == 1
        at += self.n_docs
        self.starts = part(self.n_docs + 1, "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = part(blocks, "<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError("the file ends early")
        return data

    def _block(self, i: int) -> np.ndarray:
        n = min(self.block, self.n_ids - i * self.block)
        return unpack_bits(self._read(int(self.offsets[i]), (n * self.width + 7) // 8), self.width, n)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a..b of the file, from the blocks that hold them."""
        if a >= b:
            return np.empty(0, np.uint32)
        first = a // self.block
        parts = [self._block(i) for i in range(first, (b - 1) // self.block + 1)]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order; about ``at_once`` ids are unpacked at a time."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + at_once, "right")) - 1)
            base = int(self.starts[i])
            ids = self.read(base, int(self.starts[j]))
            for k in range(i, j):
                yield (None if self.null[k] else int(self.ids[k])), int(self.starts[k]), ids[self.starts[k] - base : self.starts[k + 1] - base]
            i = j

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, shard_mb: int = 64, memo: int = MEMO) -> list[tuple[str, int, int, int]]:
    """Write ``docs(doc_id, text)`` and return the manifest: (uri, ids before it, documents, ids) by shard."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words, out = TaskContext.get(), word_ids(tokenizer, memo), None
        uri = f"{folder}/shard-{task.partitionId():06d}.tok"
        for b in slices(batches):
            out = out or TokenWriter(Sink(uri, task.taskAttemptId()), max(words.size, end_id + 1))
            for doc_id, ids in zip(b["doc_id"].to_pylist(), words.encode(b["text"].to_pylist()), strict=True):
                out.add(doc_id, np.append(ids, words.kind.type(end_id)))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "uri": uri, "docs": n_docs, "ids": n_ids}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts_for(docs, shard_mb), "doc_id").sortWithinPartitions("doc_id", "text")
    found = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard long, uri string, docs long, ids long").collect())
    bases = np.cumsum([0, *(r[3] for r in found)])
    return [(uri, int(base), n, m) for (_, uri, n, m), base in zip(found, bases, strict=False)]


def read_tokens(spark, manifest: list[tuple[str, int, int, int]], digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files, or ids_crc32 in place of ids."""
    kind = "ids_crc32 long" if digest else "ids array<bigint>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", kind.split()[0]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())]
        for b in batches:
            for uri, base in zip(b["uri"].to_pylist(), b["base"].to_pylist(), strict=True):
                with TokenFile(uri) as f:
                    rows, size = [], 0
                    for doc_id, start, ids in f.documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids))
                        size += 1 if digest else len(ids)
                        if len(rows) >= 20_000 or size >= 1 << 22:
                            yield _rows(rows, names, types)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows, names, types)

    listed = spark.createDataFrame([(u, b) for u, b, _, _ in manifest], "uri string, base long").repartition(max(1, len(manifest)))
    return listed.mapInArrow(read, f"doc_id long, start long, n_tokens long, {kind}")


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
