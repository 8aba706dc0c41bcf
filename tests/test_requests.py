"""Requests that carry their whole conversation: tables and streams agree over several micro-batches."""

from pyspark.sql import functions as F

from threadloom.config import Compress, Config, Nudge
from threadloom.plans import frames
from threadloom.streaming.turns import stream_requests

CONFIG = Config(model_context_limit=100_000, preserve_recent_messages=0, preserve_recent_tokens=0, compress=Compress(0, 0, 0), nudge=Nudge(0.55, 0.45, 0.05, 60, 60, 40, 0.45, 0.98))
KIND = "conv_id long, request int, ord int, id string, role string, content_type string, text string, tool_name string, tool_call_id string"


def _request(conv, n, ids, call=False):
    rows = [(conv, n, i, x, "user" if i % 2 == 0 else "assistant", "text", f"{x} " * 60, None, None) for i, x in enumerate(ids)]
    text = '{"content":[{"startId":"m00001","endId":"m00002","summary":"both"}]}'
    return rows + ([(conv, n, 99, "call", "assistant", "tool-call", text, "compress", "k")] if call else [])


BATCHES = [
    [*_request(1, 1, "ab"), *_request(2, 1, "xyz", call=True)],
    [*_request(1, 2, "abcd"), *_request(1, 3, "abcdef"), *_request(2, 2, "z")],
    [*_request(2, 3, "xyz", call=True), *_request(1, 3, "ab")],
]


def test_stream_of_requests(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/in")
    query = stream_requests(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), CONFIG).writeStream
    running = query.format("memory").queryName("requests").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    for rows in BATCHES:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        running.processAllAvailable()
    running.stop()
    got = sorted(map(tuple, spark.table("requests").collect()))
    every = [r for rows in BATCHES for r in rows][: -len(_request(1, 3, "ab"))]  # the late copy of request 3 is passed over
    want = sorted(map(tuple, frames.turn_sequence(spark.createDataFrame(every, KIND), CONFIG).collect()))
    assert got == want
    by = {(r[0], r[1]): r for r in got}
    assert by[2, 1][8:] == (["b1"], []) and by[2, 2][8:] == ([], ["b1"]) and by[2, 3][8:] == (["b1"], [])
    assert [by[1, n][7] for n in (1, 2, 3)] == [None, 1, 1] and by[1, 1][5] == by[1, 3][5] == 60


def test_calls_on_nothing(spark):
    talk = spark.createDataFrame([(1, 0, "a", "user", "text", "hello", None, None)], "conv_id long, ord int, id string, role string, content_type string, text string, tool_name string, tool_call_id string")
    calls = spark.createDataFrame([(1, 1, 0, "m00001", "m00001", "s"), (2, 1, 0, "m00001", "m00001", "s"), (1, 2, 0, None, "m00001", "s"), (1, 3, 0, "m00001", "m00001", None)], "conv_id long, call int, pos int, start_ref string, end_ref string, summary string")
    rows = {(r.conv_id, r.call): (r.created, len(r.errors)) for r in frames.apply_calls(talk, calls, CONFIG).collect()}
    assert rows == {(1, 1): (1, 0), (2, 1): (0, 1), (1, 2): (0, 1), (1, 3): (0, 1)}
    assert frames.apply_calls(talk, calls.limit(0), CONFIG).count() == 0
    assert frames.blocks_of(frames.apply_calls(talk, calls.limit(0), CONFIG)).count() == 0
    assert frames.apply_calls(talk, calls, CONFIG).select(F.max(F.size("warnings"))).first()[0] == 0
