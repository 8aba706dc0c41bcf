"""Codecs, state files, search rules, and batch against stream."""

import json
import os

import pytest

from threadloom.functions import text as X
from threadloom.operators import reports, search
from threadloom.sources import codecs, store


@pytest.mark.parametrize(
    "body, kind",
    [
        ({"input": []}, "responses"),
        ({"messages": [], "system": ""}, "anthropic"),
        ({"messages": [{"role": "user", "content": [{"type": "tool_result"}]}]}, "anthropic"),
        ({"messages": [{"role": "user", "content": "x"}]}, "openai"),
        ({"messages": [{"role": "system", "content": "x"}]}, "openai"),
        ({"x": 1}, None),
        (None, None),
    ],
)
def test_detect(body, kind):
    assert codecs.detect(body) == kind


def test_anthropic_round_trip():
    messages = [
        {"role": "user", "content": [{"type": "text", "text": "hi", "cache_control": {"type": "ephemeral"}}, {"type": "image", "source": {"data": "x"}}]},
        {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm", "signature": "sig_EqMAC"}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"a": [1, "é"]}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out", "is_error": True}]},
    ]
    rows = codecs.read_body({"system": "s", "messages": messages}, "anthropic")
    assert codecs.write_body(rows.rows, "anthropic") == messages and rows.system == ["s"]
    assert [r["content_type"] for r in rows.rows] == ["text", "text", "reasoning", "tool-call", "tool-result"]
    assert rows.rows[1]["text"] == "[image]"


def test_openai_round_trip():
    messages = [
        {"role": "user", "content": "q"},
        {"role": "assistant", "content": "a", "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": '{"x":1}'}}], "reasoning_content": "r"},
        {"role": "tool", "tool_call_id": "c", "content": "o"},
        {"role": "developer", "content": "late"},
        {"role": "user", "content": [{"type": "image_url", "image_url": {"url": "data:image/png;base64,QQ=="}}]},
    ]
    rows = codecs.read_body({"messages": [{"role": "system", "content": "head"}, *messages]}, "openai")
    assert codecs.write_body(rows.rows, "openai") == messages and rows.system == ["head"]
    assert codecs.inject_system(messages, ["x"])[0] == {"role": "system", "content": "x"}


def test_responses_patch():
    items = [
        {"type": "additional_tools", "tools": []},
        {"type": "message", "role": "developer", "content": "rules"},
        {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]},
        {"type": "reasoning", "id": "rs1", "summary": []},
        {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"},
        {"type": "function_call_output", "call_id": "c", "output": "o"},
        {"type": "custom_tool_call", "call_id": "d", "name": "g", "input": "i"},
    ]
    body = {"input": items}
    rows = codecs.read_body(body).rows
    assert codecs.patch_responses(body, rows) == [i for i in items if i.get("role") != "developer"]
    edited = [dict(r, text="new") if r["text"] == "q" else r for r in rows if r["content_type"] != "reasoning"]
    extra = {"id": "n", "role": "system", "content_type": "text", "text": "sum", "tool_name": None, "tool_call_id": None, "side": None}
    out = codecs.patch_responses(body, [extra, *edited])
    assert out[1] == {"type": "message", "role": "developer", "content": "sum"} and out[2]["content"][0]["text"] == "new" and all(i["type"] != "reasoning" for i in out)
    assert codecs.patch_responses({"input": "hey"}, codecs.read_body({"input": "hey"}, "responses").rows) == "hey"


@pytest.mark.parametrize("text, split", [("<think>\na\n</think>\nb", ("a", "b")), ("<thinking>\na\n</thinking>```thinking\nc\n```d", ("a\nc", "d")), ("<think>\nopen", None), ("x <think>\na\n</think>", None)])
def test_thinking(text, split):
    assert codecs.split_thinking(text) == split


def test_repeated_content_gets_numbers():
    rows = codecs.read_body({"messages": [{"role": "user", "content": "x"}] * 3}, "openai").rows
    assert [r["id"][18:] for r in rows] == ["", "_1", "_2"]


@pytest.mark.parametrize("kind", codecs.FORMATS)
def test_mirror_has_the_ids_of_live_traffic(kind):
    view = [{"role": "user", "blocks": [{"type": "text", "text": "q"}]}, {"role": "assistant", "blocks": [{"type": "thinking", "text": "t"}, {"type": "text", "text": "a"}, {"type": "tool_call", "id": "c", "name": "f", "input": "{}"}]}, {"role": "tool", "blocks": [{"type": "tool_result", "id": "c", "text": "o"}]}]
    a, b = codecs.mirror_rows(view, kind), codecs.mirror_rows(view, "openai")
    assert [r["id"] for r in a] == [r["id"] for r in b]


def test_state_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    frame = spark.createDataFrame([("a", '{"x": 1}'), ("b", '{"y": "é"}'), (None, "{}")], "id string, payload string")
    assert store.save(frame, root, now=5) == 2
    os.makedirs(tmp_path / "deep")
    (tmp_path / "deep" / "bad.json").write_text("{no")
    (tmp_path / "other.json").write_text(json.dumps({"version": 2, "savedAt": 1, "id": "c", "payload": {}}))
    (tmp_path / ".tmp-1-x.json").write_text("{}")
    assert sorted((r.id, r.version, r.saved_at, r.payload) for r in store.load(spark, root).collect()) == [("a", 2, 5, '{"x":1}'), ("b", 2, 5, '{"y":"é"}')]
    assert store.load(spark, root, strict_names=False).count() == 3
    assert store.lookup(spark, root, "a").count() == 1
    for bad in ("../x", "/x", "a/../b", ""):
        with pytest.raises(ValueError):
            store.safe_path(bad)


@pytest.mark.parametrize("word, stem", [("authenticate", "authenticate"), ("authenticated", "authenticat"), ("authentication", "authenticat"), ("cities", "city"), ("boxes", "box"), ("glass", "glass"), ("is", "is")])
def test_stems(spark, word, stem):
    assert X.stem_word(word) == stem
    assert spark.range(1).select(X.stem(__import__("pyspark").sql.functions.lit(word)).alias("s")).first()["s"] == stem


def test_bigrams(spark):
    f = __import__("pyspark").sql.functions
    row = spark.range(1).select(X.bigrams(f.lit("登录")).alias("a"), X.bigrams(f.lit("可视 化")).alias("b"), X.bigrams(f.lit("a")).alias("c"), X.words(f.lit("!! 4096 value=4096")).alias("d")).first()
    assert tuple(map(list, row)) == (["登录"], ["可视"], [], ["value"])


def _docs(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}", "block", None, t) for i, t in enumerate(texts)], "doc_ord long, ref string, kind string, role string, text string")


def test_ranking(spark):
    found = search.search(_docs(spark, "tokenized", "token"), "token").collect()
    assert found[0]["ref"] == "d1" and found[0]["score"] >= 0.7
    found = search.search(_docs(spark, "auth token refresh", "tokanxyz"), "tokan").collect()
    assert found[0]["ref"] == "d1" and found[0]["score"] <= 0.31
    assert search.search(_docs(spark, "缓存策略 redis 层"), "缓存", "fuzzy").first()["score"] == 1
    for q in ("验", "ok", "to"):
        assert search.search(_docs(spark, "缓存策略 redis 层 ok to"), q, "fuzzy").count() == 0
    assert search.search(_docs(spark, "x"), "x", "nothing like it").count() == 0


def test_number_formats():
    assert [reports.fixed1(x) for x in (1.25, 1.15, 0.05)] == ["1.3", "1.1", "0.1"]
    assert [reports.format_short(n) for n in (999, 1000, 12_345)] == ["999", "1.0K", "12K"]
    assert reports.percent(1, 1000) == 1 and reports.percent(0, 5) == 0 and reports.bar(1, 2, 4) == "██░░"
    with pytest.raises(ValueError):
        reports.resolve_prompts({"aim": "x"})


def test_stream_equals_batch(spark, tmp_path):
    from threadloom.queries import CONFIG
    from threadloom.sources.tables import conversation_messages, read
    from threadloom.streaming.turns import batch_turns, stream_turns

    frame = conversation_messages(read(spark, "/root/testdata/sf0.001", "conversations")).filter("conv_id < 12")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = stream_turns(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), CONFIG).writeStream.format("memory").queryName("turns").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("turns").collect())) == sorted(map(tuple, batch_turns(frame, CONFIG).collect()))


def test_state_stream(spark, tmp_path):
    frame = spark.createDataFrame([("a", '{"x": 1}')], "id string, payload string")
    frame.write.parquet(f"{tmp_path}/in")
    query = store.save_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert [r.id for r in store.load(spark, f"file://{tmp_path}/out").collect()] == ["a"]


def test_defaults():
    assert store.merge_defaults({"a": None, "n": {"x": 1}}, {"a": 2, "n": {"x": 0, "y": 3}}) == {"a": 2, "n": {"x": 1, "y": 3}}


def test_counter_by_vocabulary(spark):
    pt = pytest.importorskip("public_tokenizers")
    from threadloom.functions.counters import LONGEST, bpe_counter
    from pyspark.sql import functions as F

    count = bpe_counter(pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN)
    rows = spark.createDataFrame([(1, "hello world"), (2, None), (3, "a" * (LONGEST + 4))], "i int, t string")
    assert [r["n"] for r in rows.select("i", count(F.col("t")).alias("n")).orderBy("i").collect()] == [2, 0, (LONGEST + 4) // 4]
