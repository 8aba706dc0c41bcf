"""Groups of rows through Python as a stream.

A grouped map builds frames for each group, which costs more than the work on a group of some rows.  Here rows are
dealt by key and sorted, a batch holds many groups, and a group that goes on in the next batch waits for its rest;
no more than that group and one batch are held, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What is given back at once: rows, and characters of text.
ROWS, CHARS = 4_000, 4 << 20
#: Characters of a piece of a long text.
PIECE = 2048


def groups(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[tuple[object, list[tuple]]]:
    """(key, rows) of neighbours with one key, which is their column ``at``."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[at] != key:
                yield key, held
                held = []
            key = row[at]
            held.append(row)
    if held:
        yield key, held


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) * (8 if isinstance(v, list) else 1) for v in row if isinstance(v, (str, list)))
        if len(held) >= ROWS or size >= CHARS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def by_key(rows: DataFrame, key: str, order: list[str | Column], run: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``run(key, rows)`` for each value of ``key``, its rows as tuples of all columns in the given order."""
    at, shape = rows.columns.index(key), arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for k, group in groups(batches, at) for out in run(k, group)), shape)

    # By a hash of the key: where parts of a union are dealt by the key itself, Spark takes that for the union's own
    # dealing and leaves this one out, though adaptive execution may have merged the parts' partitions differently.
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(stream, schema)


def pieces(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows' keys and texts for :func:`texts`.  Texts of any length go in pieces, so that a batch has a bounded size:
    without that, ten thousand rows are one batch, whatever they hold."""
    cut = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return rows.select(F.col(key).alias("_key"), cut.alias("_cut")).select("_key", F.posexplode_outer("_cut").alias("_pos", "_piece"))


def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str | None]]:
    """(key, text) of each row behind :func:`pieces`."""
    held: list = []
    for batch in batches:
        for k, pos, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not pos and held:
                yield held[0], "".join(held[1:])
                held = []
            if pos is None:
                yield k, None
            else:
                held = held or [k]
                held.append(piece)
    if held:
        yield held[0], "".join(held[1:])


def some(rows: Iterable[tuple[object, str | None]], most: int = 512) -> Iterator[list[tuple[object, str | None]]]:
    """Rows of (key, text) together: ``most`` of them, or ``CHARS`` characters and one row more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if len(held) >= most or size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def by_text(rows: DataFrame, key: str, text: str, run: Callable[[object, str | None], Iterable[tuple]], schema: str) -> DataFrame:
    """``run(key, text)`` for each row."""
    shape = arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for k, t in texts(batches) for out in run(k, t)), shape)

    return pieces(rows, key, text).mapInArrow(stream, schema)
