"""Versioned JSON state, one file for each id.

Writing is by the tasks that hold the rows, under a name of their own and then moved into place;
reading is Spark's text source.  What is damaged, orphaned, refused or misnamed is left out of
:func:`load` and listed by :func:`skipped`.  Files are never deleted.
"""

from __future__ import annotations

import hashlib
import json
import logging
import re
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
VERSION = 2


def file_name(state_id: str) -> str:
    return hashlib.sha256(state_id.encode()).hexdigest()[:24] + ".json"


def safe_path(path: str) -> str:
    """A relative path without a way out of the store."""
    parts = re.split(r"[\\/]+", path)
    if not path or path.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise ValueError(f"{path!r} leaves the store")
    return "/".join(p for p in parts if p not in ("", "."))


def _put(store, base: str, place: str, own: str, state_id: str, payload, now: int) -> None:
    _put_text(store, base, place, own, json.dumps({"version": VERSION, "savedAt": now, "id": state_id, "payload": payload}, ensure_ascii=False))


def _put_text(store, base: str, place: str, own: str, text: str, tries: int = 3) -> None:
    """One file, whole or not at all; a place that is locked for a moment is tried again."""
    folder, _, name = f"{base}/{place}".rpartition("/")
    store.create_dir(folder, recursive=True)
    temp = f"{folder}/.tmp-{own}-{name}"
    try:
        with store.open_output_stream(temp) as out:
            out.write(text.encode())
        for n in range(tries):
            try:
                return store.move(temp, f"{folder}/{name}")
            except PermissionError:
                if n + 1 == tries:
                    raise
                time.sleep(0.02 * (n + 1))
    except BaseException:
        if store.get_file_info(temp).is_file:
            store.delete_file(temp)
        raise


def _place(state_id: str, payload, path_of) -> str:
    """Where ``path_of`` puts a state, or its own name where that would leave the store."""
    if path_of is None or not (path := path_of(state_id, payload)):
        return file_name(state_id)
    try:
        return safe_path(path)
    except ValueError:
        log.warning("%r leaves the store; the state gets its own name", path)
        return file_name(state_id)


def save(states: DataFrame, root: str, now: int, path_of=None, order: str | None = None) -> int:
    """Write ``states(id, payload JSON)`` and return how many files that are.

    Of rows with one id the last by the column ``order`` wins, of equal ones the greatest payload.
    Rows of a table have no order of their own, so without that column an id with different payloads
    fails the write.  ``path_of(id, payload)`` may place a file elsewhere under ``root``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["payload"], strict=True):
                payload = json.loads(text)
                _put(store, base, _place(i, payload, path_of), str(attempt), i, payload, now)
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows = states.filter("id is not null and payload is not null").groupBy("id")
    if order:
        last = rows.agg(F.max_by("payload", F.struct(order, "payload")).alias("payload"))
    else:
        unclear = F.raise_error(F.concat(F.lit("several payloads of one id need an order column: "), F.col("id")))
        last = rows.agg(F.min("payload").alias("payload"), F.max("payload").alias("most")).select("id", F.when(F.col("payload") == F.col("most"), F.col("payload")).otherwise(unclear.cast("string")).alias("payload"))
    return last.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def put_texts(files: DataFrame, root: str) -> int:
    """Write ``files(place, text)`` as they are, each below ``root``, and return how many that are.  The tasks that
    hold the rows write them: a partitioned table would be a folder, a commit and a move by the driver for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for pdf in batches:
            for place, text in zip(pdf["place"], pdf["text"], strict=True):
                _put_text(store, base, safe_path(place), str(attempt), text)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("place", "text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Saver:
    """Debounced saving from one process: requests for an id within ``wait`` seconds are one write, of what
    ``build`` gives when it is written.  A failed write is logged and leaves the old file."""

    def __init__(self, root: str, wait: float = 0.5, path_of=None, clock: Callable[[], float] = time.time):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(root)
        self.wait, self.path_of, self.clock = wait, path_of, clock
        self._builds: dict[str, Callable] = {}
        self._timers: dict[str, threading.Timer] = {}
        self._lock, self._writing, self._n = threading.Lock(), threading.Lock(), 0

    def schedule(self, state_id: str, build: Callable) -> None:
        with self._lock:
            self._builds[state_id] = build
            if state_id not in self._timers:
                timer = self._timers[state_id] = threading.Timer(self.wait, self.flush, (state_id,))
                timer.daemon = True
                timer.start()

    def pending(self) -> list[str]:
        with self._lock:
            return list(self._timers)

    def _take(self, state_id: str) -> Callable | None:
        with self._lock:
            if timer := self._timers.pop(state_id, None):
                timer.cancel()
            return self._builds.pop(state_id, None)

    def flush(self, state_id: str, build: Callable | None = None) -> bool:
        """Write now what is pending for an id, or ``build``; whether nothing went wrong."""
        pending = self._take(state_id)
        build = build or pending
        if build is None:
            return True
        try:
            with self._writing:  # one write at a time, in the order of the requests
                self._n += 1
                payload = build()
                _put(self.store, self.base, _place(state_id, payload, self.path_of), f"p{id(self)}-{self._n}", state_id, payload, int(self.clock() * 1000))
            return True
        except Exception:
            log.exception("saving %s failed", state_id)
            return False

    def flush_all(self) -> bool:
        return all([self.flush(i) for i in self.pending()])

    def cancel(self) -> None:
        for i in self.pending():
            self._take(i)


def save_stream(states: DataFrame, root: str, checkpoint: str, every: str = "1 second", order: str | None = None):
    """A running query that saves ``states(id, payload)`` as they come: rows of one interval are one
    write for each id, the last by ``order``; stopping flushes what has come, and a restart goes on from
    the checkpoint."""
    write = lambda batch, _: save(batch, root, int(time.time() * 1000), order=order)
    return states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _read(raw: DataFrame, strict_names: bool, adopt, valid) -> DataFrame:
    """Every file of ``raw(value)`` with its envelope's fields and ``reason``, null if it is sound."""
    v = F.try_parse_json("value")
    enveloped = (F.schema_of_variant(F.try_variant_get(v, "$.id", "variant")) == "STRING") & F.try_variant_get(v, "$.payload", "variant").isNotNull()
    own = F.struct(
        F.try_variant_get(v, "$.id", "string").alias("id"),
        F.try_variant_get(v, "$.version", "int").alias("version"),
        F.try_variant_get(v, "$.savedAt", "long").alias("saved_at"),
        F.to_json(F.try_variant_get(v, "$.payload", "variant")).alias("payload"),
    )
    enveloped = F.coalesce(enveloped, F.lit(False))
    taken = F.when(enveloped, own)
    if adopt is not None:
        old = adopt(v)
        stamped = F.struct(old["id"].alias("id"), F.coalesce(old["version"], own["version"], F.lit(VERSION)).alias("version"), F.coalesce(old["saved_at"], own["saved_at"], F.lit(0)).cast("long").alias("saved_at"), old["payload"].alias("payload"))
        taken = F.when(enveloped, own).when(old["id"].isNotNull() & old["payload"].isNotNull(), stamped)
    rows = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), v.isNotNull().alias("json"), taken.alias("e")).select("file", "json", "e.*")
    whole = F.coalesce((F.col("id") != "") & F.col("version").isNotNull() & F.col("payload").isNotNull() & (F.col("payload") != "null"), F.lit(False))
    named = F.col("file") == F.concat(F.substring(F.sha2("id", 256), 1, 24), F.lit(".json"))
    fine = F.coalesce(valid(F.col("id"), F.col("payload")), F.lit(False)) if valid is not None else F.lit(True)
    reason = F.when(F.col("file").startswith(".tmp-"), "orphan").when(~F.col("json"), "corrupt").when(~whole, "no envelope").when(~fine, "invalid")
    return rows.withColumn("reason", reason.when(~named, "name does not match") if strict_names else reason).drop("json")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)


def load(spark: SparkSession, root: str, strict_names: bool = True, adopt: Callable[[Column], Column] | None = None, valid: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, version, saved_at, payload JSON) of every sound file below ``root``.

    ``adopt(variant)`` gives a struct (id, version, saved_at, payload) for files of an older shape, its
    fields null where it refuses; ``valid(id, payload)`` may refuse records.
    """
    return _read(_files(spark, root), strict_names, adopt, valid).filter("reason is null").select("id", "version", "saved_at", "payload")


def skipped(spark: SparkSession, root: str, strict_names: bool = True, adopt=None, valid=None) -> DataFrame:
    """(file, reason) of what :func:`load` leaves out: orphan, corrupt, no envelope, invalid, name does not match."""
    return _read(_files(spark, root), strict_names, adopt, valid).filter("reason is not null").select("file", "reason")


def merge_defaults(payload: dict, defaults: dict) -> dict:
    """A payload of an older shape with what it lacks, group by group."""
    out = defaults | {k: v for k, v in payload.items() if v is not None}
    return out | {k: merge_defaults(payload[k], d) for k, d in defaults.items() if isinstance(d, dict) and isinstance(payload.get(k), dict)}


def lookup(spark: SparkSession, root: str, state_id: str, hint: str | None = None, **how) -> DataFrame:
    """The record of one id, from the place that ``hint`` names or its own: no other file is listed or read."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    for place in ([safe_path(hint)] if hint else []) + [file_name(state_id)]:
        if store.get_file_info(f"{base}/{place}").is_file:
            found = _read(spark.read.text(f"{root}/{place}", wholetext=True), False, how.get("adopt"), how.get("valid"))
            found = found.filter((F.col("id") == state_id) & F.col("reason").isNull()).select("id", "version", "saved_at", "payload")
            if not found.isEmpty():
                return found
    return spark.createDataFrame([], "id string, version int, saved_at long, payload string")
