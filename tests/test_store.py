"""State files: which row of an id wins, retries, the in-process saver, older shapes, and single reads."""

import json
import time

import pytest
from pyspark.sql import functions as F

from threadloom.sources import store


def test_the_last_row_of_an_id_wins(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [("a", 1, '{"n": 10}'), ("a", 2, '{"n": 9}'), ("b", 1, '{"n": 1}'), ("b", 1, '{"n": 2}')]
    frame = spark.createDataFrame(rows, "id string, seq int, payload string").repartition(3)
    assert store.save(frame, root, now=1, order="seq") == 2
    assert {r.id: r.payload for r in store.load(spark, root).collect()} == {"a": '{"n":9}', "b": '{"n":2}'}
    with pytest.raises(Exception, match="order column"):
        store.save(frame, root, now=1)
    assert store.save(frame.filter("seq = 1 and id = 'a'").unionAll(frame.filter("seq = 1 and id = 'a'")), root, now=2) == 1


def test_streamed_states_keep_the_newest(spark, tmp_path):
    kinds = "id string, seq int, payload string"
    spark.createDataFrame([("a", 1, '{"n": 10}'), ("a", 2, '{"n": 9}')], kinds).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = store.save_stream(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"{tmp_path}/cp", order="seq")
    query.processAllAvailable()
    spark.createDataFrame([("a", 3, '{"n": 8}')], kinds).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    assert [r.payload for r in store.load(spark, f"file://{tmp_path}/out").collect()] == ['{"n":8}']


def test_locked_places_are_tried_again(tmp_path):
    from pyarrow import fs

    real = fs.LocalFileSystem()

    class Locked:
        def __init__(self, times):
            self.times = times

        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, a, b):
            self.times -= 1
            if self.times >= 0:
                raise PermissionError(b)
            real.move(a, b)

    store._put(Locked(2), str(tmp_path), "x.json", "1", "x", {"n": 1}, 5)
    assert json.loads((tmp_path / "x.json").read_text()) == {"version": store.VERSION, "savedAt": 5, "id": "x", "payload": {"n": 1}}
    with pytest.raises(PermissionError):
        store._put(Locked(9), str(tmp_path), "y.json", "1", "y", {}, 5)
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]


def test_saver(spark, tmp_path):
    saver = store.Saver(f"file://{tmp_path}", wait=60, clock=lambda: 1.5)
    held = {"n": 1}
    saver.schedule("a", lambda: dict(held))
    saver.schedule("a", lambda: dict(held))
    saver.schedule("b", lambda: 1 / 0)
    held["n"] = 2
    assert saver.pending() == ["a", "b"]
    assert saver.flush("a") and not saver.flush("b") and saver.pending() == [] and saver.flush("a")
    saver.schedule("c", lambda: {})
    saver.cancel()
    assert saver.pending() == [] and saver.flush_all()
    assert saver.flush("d", lambda: {"now": True})
    assert sorted((r.id, r.saved_at, r.payload) for r in store.load(spark, f"file://{tmp_path}").collect()) == [("a", 1500, '{"n":2}'), ("d", 1500, '{"now":true}')]
    soon = store.Saver(f"file://{tmp_path}", wait=0.05)
    soon.schedule("e", lambda: {"n": 3})
    for _ in range(100):
        time.sleep(0.05)
        if not soon.pending() and (tmp_path / store.file_name("e")).exists():
            break
    assert json.loads((tmp_path / store.file_name("e")).read_text())["payload"] == {"n": 3}


def test_places_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}"
    frame = spark.createDataFrame([("a", '{"kind": "x"}'), ("b", '{"kind": "../../out"}')], "id string, payload string")
    store.save(frame, root, now=1, path_of=lambda i, p: f"{p['kind']}/{i}.json")
    assert (tmp_path / "x" / "a.json").exists() and (tmp_path / store.file_name("b")).exists()
    assert store.load(spark, root, strict_names=False).count() == 2
    assert store.lookup(spark, root, "a").count() == 0
    assert [r.payload for r in store.lookup(spark, root, "a", hint="x/a.json").collect()] == ['{"kind":"x"}']
    assert store.lookup(spark, root, "b", hint="x/a.json").count() == 1 and store.lookup(spark, root, "none").count() == 0


def test_what_is_left_out(spark, tmp_path):
    files = {"1.json": "{no", "2.json": '{"id": 5, "payload": {}}', "3.json": '{"id": "c", "version": 2, "savedAt": 1, "payload": {"n": -1}}', ".tmp-1-4.json": "{}", store.file_name("d"): '{"id": "d", "version": 2, "savedAt": 1, "payload": {"n": 1}}', "6.json": '{"session": "old", "turns": 3}', "7.json": '{"id": "e", "version": 2, "payload": null}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    how = {
        "adopt": lambda v: F.struct(F.try_variant_get(v, "$.session", "string").alias("id"), F.lit(None).cast("int").alias("version"), F.lit(9).cast("long").alias("saved_at"), F.to_json(F.try_variant_get(v, "$.turns", "variant")).alias("payload")),
        "valid": lambda i, p: F.coalesce(F.get_json_object(p, "$.n").cast("int"), F.lit(0)) >= 0,
    }
    good = sorted((r.id, r.version, r.saved_at, r.payload) for r in store.load(spark, root, strict_names=False, **how).collect())
    assert good == [("d", 2, 1, '{"n":1}'), ("old", store.VERSION, 9, "3")]
    assert {r.file: r.reason for r in store.skipped(spark, root, strict_names=False, **how).collect()} == {"1.json": "corrupt", "2.json": "no envelope", "3.json": "invalid", "7.json": "no envelope"}
    assert {r.reason for r in store.skipped(spark, root).filter("file = '3.json'").collect()} == {"name does not match"}


def test_texts_are_put_as_they_are(spark, tmp_path):
    """One file each, in the folders they name; no folder and no table for a row."""
    rows = spark.range(200).selectExpr("concat('old/', id % 4, '/', id, '.json') AS place", "concat('{', id, char(10), 'x') AS text")
    root = f"file://{tmp_path}/texts"
    assert store.put_texts(rows, root) == 200 and store.put_texts(rows, root) == 200
    files = sorted(p.relative_to(tmp_path / "texts").as_posix() for p in (tmp_path / "texts").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert files == sorted(f"old/{i % 4}/{i}.json" for i in range(200))
    assert (tmp_path / "texts/old/3/7.json").read_text() == "{7\nx"
