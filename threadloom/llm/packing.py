"""Bounded-space online packing of token ids into windows of a fixed length.

A task keeps at most ``open_windows`` windows.  A document's whole windows leave at once; its rest
goes to the window where it fits best.  When it fits nowhere and no more windows may open, the
fullest one takes the head of the rest, is emitted, and the tail is placed anew: what is emitted
is always full.  The windows still open when a task ends go to a second, much smaller round that
joins them end to end; the last window of each of its tasks is cut at powers of two, which need
no padding.

Each id lies in exactly one piece.  Null texts are empty (the end id alone), null doc_ids stay,
repeated rows are packed like any others, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash
from .word_ids import MEMO, word_ids

WINDOW = 4096
#: Ids of left windows for each task of the second round.
MERGE_IDS = 1 << 23
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("left_in", pa.int64()),
    ]
)
_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids array<int>, left_in long"

#: A piece: document, ids before it, its ids, ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Online best fit over a fixed number of open windows; ``full`` gets the pieces of each full one."""

    def __init__(self, full, window: int = WINDOW, open_windows: int = 16):
        self.full, self.window, self.most = full, window, open_windows
        self.open: list[tuple[int, list[Piece]]] = []  # (free ids, pieces)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        at = n // w * w
        for a in range(0, at, w):
            self.full([(doc_id, a, ids[a : a + w], n)])
        while at < n:
            rest = n - at
            fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= rest]
            if not fits and len(self.open) < self.most:
                self.open.append((w - rest, [(doc_id, at, ids[at:], n)]))
                return
            free, i = min(fits or [(f, i) for i, (f, _) in enumerate(self.open)])
            take = min(free, rest)
            pieces = self.open[i][1]
            pieces.append((doc_id, at, ids[at : at + take], n))
            at += take
            if take == free:
                self.open.pop(i)
                self.full(pieces)
            else:
                self.open[i] = (free - take, pieces)

    def left(self) -> list[list[Piece]]:
        return [p for _, p in self.open]


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Rows:
    """Pieces as rows of ``_OUT``; ``keep`` says whether the ids stay beside their checksum."""

    def __init__(self, keep: bool, tag: int):
        self.keep, self.next, self.rows, self.size = keep, tag, [], 0

    def window(self, pieces: list[Piece], left_in: int | None = None) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes()) if left_in is None else None
            self.rows.append((doc_id, start, len(ids), n, self.next if left_in is None else None, at, crc, ids.astype(np.int32) if self.keep or left_in is not None else None, left_in))
            self.size += 1 + (len(ids) if self.keep else 0)
            at += len(ids)
        self.next += 1

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _OUT, strict=True)], schema=_OUT)
            self.rows, self.size = [], 0


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, open_windows: int = 16, keep_ids: bool = True, memo: int = MEMO) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for each piece."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, rows = word_ids(tokenizer, memo), _Rows(keep_ids, part << 32)
        packer = Packer(rows.window, window, open_windows)
        for b in slices(batches):
            for doc_id, ids in zip(b["doc_id"].to_pylist(), words.encode(b["text"].to_pylist()), strict=True):
                packer.add(doc_id, np.append(ids, words.kind.type(end_id)))
            yield from rows.take(500_000 if keep_ids else 50_000)
        for i, pieces in enumerate(packer.left()):
            rows.window(pieces, part << 16 | i)
        yield from rows.take(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(keep_ids, 1 << 62 | TaskContext.get().partitionId() << 32)
        held, free = [], window
        for b in slices(batches):
            for doc_id, start, ids, n in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                ids = np.array(ids, np.int32)
                while len(ids):
                    take = min(free, len(ids))
                    held.append((doc_id, start, ids[:take], n))
                    ids, start, free = ids[take:], start + take, free - take
                    if not free:
                        rows.window(held)
                        held, free = [], window
            yield from rows.take(500_000 if keep_ids else 50_000)
        for size in powers(window - free):
            now, need = [], size
            while need:
                doc_id, start, ids, n = held.pop(0)
                now.append((doc_id, start, ids[:need], n))
                if len(ids) > need:
                    held.insert(0, (doc_id, start + need, ids[need:], n))
                need -= len(now[-1][2])
            rows.window(now)
        yield from rows.take(0)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stash(rows.mapInArrow(first, _DDL), "pieces")
    left = pieces.filter("left_in is not null")
    total = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = int(-(-total // MERGE_IDS)) or 1
    dealt = left.repartition(tasks, "left_in").sortWithinPartitions("left_in", "offset") if tasks > 1 else left.coalesce(1).sortWithinPartitions("left_in", "offset")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    return pieces.filter("left_in is null").select(names).unionByName(dealt.mapInArrow(merge, _DDL).select(names))
