"""Queries of compression calls, turns, requests, state files and searches by group, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import Compress, Config, Nudge
from threadloom.functions import text as X
from threadloom.operators import coverage, ranges, reports, search, status
from threadloom.plans import frames
from threadloom.plans.turn import TextFilter
from threadloom.sources import codecs, store
from threadloom.sources.tables import conversation_messages, read, sample_blocks, session_messages, store_root
from threadloom.streaming.turns import session_counts

OPEN = Config(model_context_limit=100_000, preserve_recent_messages=0, preserve_recent_tokens=0, compress=Compress(0, 0, 0))
GATE = 600
ASKED = {"one": "the license released under", "two": "token action their tokens"}


def _talk(spark, sf_dir) -> DataFrame:
    return conversation_messages(read(spark, sf_dir, "conversations"))


def _calls(talk: DataFrame, specs: list[tuple]) -> DataFrame:
    """The same calls on every conversation: (call, pos, start, end, summary)."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("call", "pos", "start_ref", "end_ref", "summary"), s, strict=True)]) for s in specs])
    return talk.select("conv_id").distinct().select("conv_id", F.explode(rows).alias("c")).select("conv_id", "c.*")


def _last_state(done: DataFrame) -> DataFrame:
    return done.groupBy("conv_id").agg(F.max_by("state", "call").alias("state"))


def tier_promotion(spark, sf_dir):
    """A first-tier block, merged upwards three times: the third tier is the last."""
    talk = _talk(spark, sf_dir)
    done = frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00002", "one"), (2, 0, "b1", "b1", "two"), (3, 0, "b2", "b2", "three"), (4, 0, "b3", "b3", "four")]), OPEN)
    blocks = frames.blocks_of(_last_state(done))
    return blocks.select("conv_id", "block_id", "tier", "active", "start_ref", F.size("direct_message_ids").alias("direct"), F.size("effective_message_ids").alias("covers"), F.array_join("direct_block_ids", ",").alias("children"), "compressed_tokens")


def resumed_calls(spark, sf_dir):
    """The same in two runs, the second from the states that the first left."""
    talk = _talk(spark, sf_dir)
    one = frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00002", "one")]), OPEN)
    two = frames.apply_calls(talk, _calls(talk, [(2, 0, "b1", "b1", "two")]), OPEN, _last_state(one))
    return two.select("conv_id", "call", "created", "tokens", F.get_json_object("state", "$.tokens_compressed").cast("long").alias("in_all"), F.get_json_object("state", "$.next_block").cast("int").alias("next_block"))


def compress_gate(spark, sf_dir):
    """A call on too little is refused as a whole."""
    talk = _talk(spark, sf_dir)
    done = frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00002", "one")]), OPEN.with_(compress=Compress(GATE, 0, 0)))
    return done.select("conv_id", "created", "tokens", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


def summary_checks(spark, sf_dir):
    talk = _talk(spark, sf_dir)
    calls = _calls(talk, [(1, 0, "m00001", "m00002", "")]).withColumn("summary", F.repeat(F.lit("s"), (F.col("conv_id") % 100).cast("int")))
    done = frames.apply_calls(talk, calls, OPEN.with_(compress=Compress(0, 80, 50)))
    return done.select("conv_id", "created", F.size("errors").alias("errors"))


def overlapping_specs(spark, sf_dir):
    """Of overlapping ranges the first counts; a reference that never was is an error of its range alone."""
    talk = _talk(spark, sf_dir)
    done = frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00002", "one"), (1, 1, "m00002", "m00002", "two"), (1, 2, "m00003", "m00003", "three"), (1, 3, "m09999", "m09999", "four")]), OPEN)
    return done.select("conv_id", "created", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


def heir_snap(spark, sf_dir):
    """A range that names a consumed block goes to the active block that took its content over."""
    talk = _talk(spark, sf_dir)
    done = frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00002", "one"), (2, 0, "b1", "b1", "two"), (3, 0, "b1", "b1", "three"), (4, 0, "b9", "b9", "four")]), OPEN)
    return done.select("conv_id", "call", "created", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


def livelock_guard(spark, sf_dir):
    """The same range twice: nothing new is an error, a wider one eats the block."""
    talk = _talk(spark, sf_dir)
    done = frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00001", "one"), (2, 0, "m00001", "m00001", "two"), (3, 0, "m00001", "m00002", "three")]), OPEN)
    return done.select("conv_id", "call", "created", "tokens", F.size("errors").alias("errors"))


def protected_compression(spark, sf_dir):
    """A whole session in one range: calls and results of protected tools stay out."""
    config = OPEN.with_(protected_tools=("bash",))
    rows = session_messages(read(spark, sf_dir, "events"))
    last = coverage.assign_refs(rows, patterns=("bash",)).filter(F.col("ref") != "BLOCKED").groupBy("conv_id").agg(F.max("ref").alias("end_ref"))
    calls = last.select("conv_id", F.lit(1).alias("call"), F.lit(0).alias("pos"), F.lit("m00001").alias("start_ref"), "end_ref", F.lit("all").alias("summary"))
    done = frames.apply_calls(rows, calls, config)
    return frames.blocks_of(done).select("conv_id", F.size("direct_message_ids").alias("direct"), F.size("effective_message_ids").alias("covers"), "compressed_tokens")


def recent_protection(spark, sf_dir):
    """A whole conversation in one range: the last two messages and the last of the user stay."""
    talk = _talk(spark, sf_dir)
    last = coverage.assign_refs(talk).groupBy("conv_id").agg(F.max("ref").alias("end_ref"))
    calls = last.select("conv_id", F.lit(1).alias("call"), F.lit(0).alias("pos"), F.lit("m00001").alias("start_ref"), "end_ref", F.lit("all").alias("summary"))
    done = frames.apply_calls(talk, calls, OPEN.with_(preserve_recent_messages=2))
    return done.select("conv_id", "created", "tokens", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


NUDGED = OPEN.with_(nudge=Nudge(0.55, 0.45, 0.05, 60, 60, 40, 0.45, 0.98))


def turn_nudges(spark, sf_dir):
    """Growth, baseline and nudges over the turns of each conversation."""
    return frames.turn_sequence(_talk(spark, sf_dir), NUDGED).select("conv_id", "request", "messages", "token_count", "growth", "baseline", "last_shown", "tier")


def vanished_messages(spark, sf_dir):
    """A block of the first two messages, then requests with and without them: it goes with what it covers and
    comes back with it."""
    talk = _talk(spark, sf_dir)
    call = F.lit('{"content":[{"startId":"m00001","endId":"m00002","summary":"both"}]}')
    ids = talk.select("conv_id").distinct()
    made = ids.select("conv_id", F.lit(1000).cast("long").alias("ord"), F.lit("call").alias("id"), F.lit("assistant").alias("role"), F.lit("tool-call").alias("content_type"), call.alias("text"), F.lit("compress").alias("tool_name"), F.lit("k").alias("tool_call_id"))
    whole = talk.unionByName(made)
    rest = whole.filter("ord >= 2")
    requests = whole.withColumn("request", F.lit(1)).unionByName(rest.withColumn("request", F.lit(2))).unionByName(whole.withColumn("request", F.lit(3)))
    out = frames.turn_sequence(requests, OPEN)
    return out.select("conv_id", "request", F.array_join("active", ",").alias("active"), F.array_join("lost", ",").alias("lost"))


def round_trip_texts(spark, sf_dir):
    """Every message's text through the block format and back."""
    made = codecs.assemble(_talk(spark, sf_dir), "anthropic").withColumn("body", F.concat(F.lit('{"system":"","messages":'), "messages", F.lit("}")))
    return codecs.flatten(made, "anthropic").select("conv_id", "ord", "text")


def round_trip_openai(spark, sf_dir):
    """Sessions through the chat format and back; there the reasoning before one answer is one text."""
    made = codecs.assemble(session_messages(read(spark, sf_dir, "events")), "openai").withColumn("body", F.concat(F.lit('{"messages":'), "messages", F.lit("}")))
    return codecs.flatten(made, "openai").groupBy("conv_id", "content_type").agg(F.when(F.col("content_type") != "reasoning", F.count("*")).alias("n"), F.count_distinct("tool_call_id").alias("calls"), F.sum(F.length("text")).alias("chars"))


def state_store_updates(spark, sf_dir):
    """A state for every turn of a conversation, in one write: the last turn's stays."""
    root = store_root(spark, "updates")
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "turn", F.to_json(F.struct("turn", "role")).alias("payload"))
    store.save(rows, root, now=1, order="turn")
    return store.load(spark, root).select("id", F.get_json_object("payload", "$.turn").cast("long").alias("turn"), F.get_json_object("payload", "$.role").alias("role"))


def state_store_legacy(spark, sf_dir):
    """Files of an older shape are adopted, invalid records refused, and what is left out is named."""
    root = store_root(spark, "legacy")
    k = F.col("conv_id") % 4
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    text = F.when(k == 0, F.to_json(F.struct(F.col("conv_id").cast("string").alias("session"), F.lit(7).alias("turns")))).when(k == 1, F.lit("{broken")).when(k == 2, F.to_json(F.struct(F.lit(2).alias("version"), F.lit(1).alias("savedAt"), F.col("conv_id").cast("string").alias("id"), F.struct(F.lit(-1).alias("turns")).alias("payload"))))
    text = text.otherwise(F.to_json(F.struct(F.lit(2).alias("version"), F.lit(1).alias("savedAt"), F.col("conv_id").cast("string").alias("id"), F.struct("conv_id").alias("payload"))))
    # Names are no concern here; folders are listed in parallel.
    place = F.concat(F.lit("old/"), F.pmod(F.xxhash64("conv_id"), F.lit(64)).cast("string"), F.lit("/"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(".json"))
    store.put_texts(rows.select(place.alias("place"), text.alias("text")), root)
    adopt = lambda v: F.struct(F.try_variant_get(v, "$.session", "string").alias("id"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("long").alias("saved_at"), F.when(F.try_variant_get(v, "$.session", "string").isNotNull(), F.to_json(F.struct(F.try_variant_get(v, "$.turns", "int").alias("turns")))).alias("payload"))
    how = {"adopt": adopt, "valid": lambda i, p: F.coalesce(F.get_json_object(p, "$.turns").cast("int"), F.lit(0)) >= 0}
    raw = spark.read.option("recursiveFileLookup", True).text(f"{root}/old", wholetext=True)
    return store._read(raw, False, **how).groupBy(F.coalesce("reason", F.lit("sound")).alias("outcome")).agg(F.count("*").alias("n"), F.count("version").alias("stamped"))


def search_duplicates(spark, sf_dir):
    """Documents that share references: scores are their own, role, weight and preview those of the last."""
    rows = read(spark, sf_dir, "documents")
    docs = rows.select(F.col("doc_id").alias("doc_ord"), (F.col("doc_id") % 50).alias("ref"), F.lit("message").alias("kind"), F.when(F.col("lang") == "en", "user").when(F.col("lang") == "fr", "assistant").otherwise("tool").alias("role"), "text")
    return search.search(docs, "license under", "substring", k=20, preview_size=60).select(F.col("doc_ord").alias("doc_id"), "ref", F.round("score", 6).alias("score"), "role", "preview")


def search_by_group(spark, sf_dir):
    """Two queries over each source's documents, a corpus each: three best of every one."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("doc_ord"), F.col("doc_id").alias("ref"), "text")
    asked = docs.select("conv_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(list(ASKED.items()), "query_id string, query string")))  # two rows
    return search.search_many(docs, asked, k=3).select("conv_id", "query_id", "rank", "ref", F.round("score", 6).alias("score"))


def bm25_indexed(spark, sf_dir):
    """The best documents of one query, from postings."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ref"), "text")
    from threadloom.queries import QUERY

    return search.top_k(search.Index(docs).bm25(QUERY), 10, ties=("ref",)).select("ref", F.round("score", 6).alias("score"))


def _letters(texts: list[str]) -> list[list[float]]:
    return [[float(t.lower().count(c)) for c in "aeiou"] for t in texts]


def semantic_topk(spark, sf_dir):
    """Ranking by vectors of the caller's own making: here, counts of five letters."""
    search.register_semantic(_letters, "letters")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").alias("ref"), F.lit("block").alias("kind"), F.lit(None).cast("string").alias("role"), "text")
    return search.search(docs, "aeiou aa ee", "letters", k=15).select("ref", F.round("score", 6).alias("score"))


def labelled_search(spark, sf_dir):
    """How well each message is found by its own first six words among those of its conversation."""
    talk = _talk(spark, sf_dir)
    docs = search.message_docs(talk).withColumn("ref", F.col("doc_ord"))
    asked = talk.select("conv_id", F.col("ord").cast("string").alias("query_id"), F.array_join(F.slice(F.split("text", "\\s+"), 1, 6), " ").alias("query"))
    found = search.search_many(docs, asked, k=10).select(F.concat_ws(":", "conv_id", "query_id").alias("query"), F.concat_ws(":", "conv_id", "ref").alias("ref"), "rank")
    expected = talk.select(F.concat_ws(":", "conv_id", "ord").alias("query"), F.concat_ws(":", "conv_id", "ord").alias("ref"))
    return search.ranking_quality(found, expected).select(*[F.round(c, 6).alias(c) for c in ("mrr", "r1", "r3")])


def search_union(spark, sf_dir):
    """Blocks and messages of a conversation as one list of documents, by kind."""
    talk = _talk(spark, sf_dir)
    docs = search.conversation_docs(talk, frames.blocks_of(frames.apply_calls(talk, _calls(talk, [(1, 0, "m00001", "m00002", "one two")]), OPEN)))
    return docs.groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("title")).alias("titles"))


def _scene(talk: DataFrame, rows: list[tuple]) -> DataFrame:
    """The same scene in every conversation, with the text of its first message: (role, content_type, tool_name, tool_call_id)."""
    first = talk.filter("ord = 0").select("conv_id", "text")
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(f"i{i}").alias("id"), F.lit(a).alias("role"), F.lit(b).alias("content_type"), F.lit(c).cast("string").alias("tool_name"), F.lit(d).cast("string").alias("tool_call_id")) for i, (a, b, c, d) in enumerate(rows)])
    return first.select("conv_id", "text", F.explode(listed).alias("m")).select("conv_id", "m.ord", "m.id", "m.role", "m.content_type", "text", "m.tool_name", "m.tool_call_id")


def _covered(rows: DataFrame, specs: list[tuple]) -> DataFrame:
    blocks = frames.blocks_of(_last_state(frames.apply_calls(rows, _calls(rows, specs), OPEN)))
    return blocks.select("conv_id", "block_id", F.array_join("direct_message_ids", ",").alias("direct"), "compressed_tokens")


def tool_pair_widening(spark, sf_dir):
    """A range that ends between calls and results takes both along, on either side."""
    call, result = ("assistant", "tool-call", "read"), ("tool", "tool-result", None)
    rows = _scene(_talk(spark, sf_dir), [(*call, "1"), (*result, "1"), (*call, "2"), ("user", "text", None, None), (*result, "2"), ("user", "text", None, None)])
    return _covered(rows, [(1, 0, "m00002", "m00003", "pairs")])


def reasoning_widening(spark, sf_dir):
    """An answer takes the reasoning before it along, and reasoning the answer behind it."""
    think, say, ask = ("assistant", "reasoning", None, None), ("assistant", "text", None, None), ("user", "text", None, None)
    rows = _scene(_talk(spark, sf_dir), [think, think, say, ask, think, say, ask, think, ask])
    return _covered(rows, [(1, 0, "m00003", "m00003", "answer"), (2, 0, "m00005", "m00005", "thought"), (3, 0, "m00008", "m00008", "alone")])


def turn_filters(spark, sf_dir):
    """Text filters of a turn: one changes texts, one keeps the last of its kind, one fails and changes nothing."""
    on = (TextFilter("mark", lambda text, *_: text.replace("th", "TH")), TextFilter("fails", lambda *_: 1 / 0), TextFilter("last", lambda text, role, *_: text if role == "user" else None, keep_last_only=True))
    shown = frames.turns(_talk(spark, sf_dir), OPEN.with_(filters_enabled=True), "none", on)
    return shown.select("conv_id", "ord", "text")


def request_kinds(spark, sf_dir):
    """The formats of request bodies of five shapes."""
    k = F.col("conv_id") % 5
    body = F.when(k == 0, '{"input":[]}').when(k == 1, '{"system":"","messages":[]}').when(k == 2, '{"messages":[{"role":"user","content":[{"type":"tool_result"}]}]}').when(k == 3, '{"messages":[{"role":"system","content":"x"}]}').otherwise("no body")
    return codecs.kinds(read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("body", body))


def unreadable_requests(spark, sf_dir):
    """Bodies that give no messages, and why."""
    k = F.col("conv_id") % 4
    body = F.when(k == 0, "{broken").when(k == 1, '{"messages":[{"role":"user","content":"fine"}]}').when(k == 2, '{"input":[{"type":"function_call","arguments":"no call"}]}').otherwise("[1]")
    return codecs.unreadable(read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("body", body))


def round_trip_responses(spark, sf_dir):
    """Sessions through the item format and back: calls, results and texts, but no reasoning of a foreign format."""
    rows = session_messages(read(spark, sf_dir, "events")).filter("content_type <> 'reasoning'")
    made = codecs.assemble(rows, "responses").withColumn("body", F.concat(F.lit('{"input":'), "messages", F.lit("}")))
    return codecs.flatten(made, "responses").select("conv_id", "ord", "content_type", "tool_call_id", F.length("text").alias("chars"))


def viable_ranges(spark, sf_dir):
    """Ranges worth a call."""
    from threadloom.queries import compressible_ranges

    return ranges.viable(compressible_ranges(spark, sf_dir), 700).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def session_windows(spark, sf_dir):
    """Events by user and session window, as the stream counts them."""
    out = session_counts(read(spark, sf_dir, "events"), "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("most"), F.sum("n").alias("events"))


def block_listing(spark, sf_dir):
    """Active blocks by what they hold, by age and by time."""
    blocks = sample_blocks(_talk(spark, sf_dir)).withColumns({"created_at": F.col("conv_id") * 3 - F.col("block_num"), "survived_count": F.col("block_num") % 2})
    out = None
    for sort in ("size", "age", "time"):
        one = reports.block_listing(blocks, sort, 2).select("conv_id", F.lit(sort).alias("sort"), "nth", "block_id", "summary_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def message_listing_sorts(spark, sf_dir):
    rows = session_messages(read(spark, sf_dir, "events"))
    shown = reports.visible_messages(rows, coverage.assign_refs(rows), sample_blocks(rows).limit(0))
    out = None
    for sort, tool in (("time", None), ("tool", None), ("size", "bash")):
        one = reports.message_listing(shown, sort, 4, tool).select("conv_id", F.lit(sort).alias("sort"), "nth", "ref", "tokens", "tool")
        out = one if out is None else out.unionByName(one)
    return out


def _report(spark, sf_dir, scope: str, **how) -> DataFrame:
    talk = _talk(spark, sf_dir)
    return status.status_report(talk, coverage.assign_refs(talk), sample_blocks(talk), scope, **how)


def status_overview(spark, sf_dir):
    return _report(spark, sf_dir, "overview")


def status_compressed(spark, sf_dir):
    return _report(spark, sf_dir, "compressed", limit=1)


def status_messages(spark, sf_dir):
    return _report(spark, sf_dir, "messages", sort="time", limit=3)


def status_ranges(spark, sf_dir):
    return _report(spark, sf_dir, "ranges")


def nudge_reasons(spark, sf_dir):
    from threadloom.queries import CONFIG

    rows = session_messages(read(spark, sf_dir, "events"))
    merged = ranges.merged_ranges(ranges.compressible_ranges(rows, coverage.assign_refs(rows), CONFIG), 1500)
    pending = reports.pending_by_tier(merged, sample_blocks(rows), 1500)
    turns = pending.withColumns({"token_count": F.col("conv_id") * 677 % 60_000 + 20, "baseline": F.col("conv_id") % 3 * 100, "last_shown": F.lit(0), "shown2": F.lit(0), "shown3": F.lit(0)})
    return reports.explain_nudge(turns, CONFIG).select("conv_id", F.col("reference").cast("long").alias("reference"), "step", F.col("floor").cast("long").alias("floor"), "over_limit", "emergency", "reason")


def recap_texts(spark, sf_dir):
    return reports.recap_text(sample_blocks(_talk(spark, sf_dir)))


def recap_block(spark, sf_dir):
    """One block in full where it is active, and what is said where it isn't or where there is none."""
    return reports.recap_text(sample_blocks(_talk(spark, sf_dir)), "b1").unionByName(reports.recap_text(sample_blocks(_talk(spark, sf_dir)), "b3"))


def queries() -> dict:
    skip = {"queries", "oracle_sql"}
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def _bm25_sql(stem: str) -> str:
    terms = ", ".join(f"('{i}', '{w}')" for i, q in ASKED.items() for w in X.query_tokens(q))
    return f"""{stem},
        q(query_id, w) AS (VALUES {terms}),
        d AS (SELECT doc_id, source FROM documents),
        len_ AS (SELECT d.doc_id, d.source, count(s.w) AS len FROM d LEFT JOIN stm s USING (doc_id) GROUP BY 1, 2),
        avg_ AS (SELECT source, avg(len) AS a, count(*) AS n FROM len_ GROUP BY 1),
        tf AS (SELECT doc_id, w, count(*) AS f FROM stm WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
        df AS (SELECT source, w, count(*) AS d FROM tf JOIN d USING (doc_id) GROUP BY 1, 2),
        bm AS (SELECT l.source, q.query_id, l.doc_id, sum(ln(1 + (n - df.d + 0.5) / (df.d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))) AS score
               FROM tf JOIN q USING (w) JOIN len_ l USING (doc_id) JOIN avg_ USING (source) JOIN df ON df.source = l.source AND df.w = tf.w GROUP BY 1, 2, 3),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm WHERE score >= 0.01)
        SELECT source AS conv_id, query_id, rank, doc_id AS ref, round(score, 6) AS score FROM r WHERE rank <= 3"""


def _labelled_sql(stem: str) -> str:
    """The same tokens and scores over messages, once for documents and once for queries."""
    docs = stem.replace("FROM documents", "FROM msgs")
    asked = re.sub(r"\b(tok|s1|s2|s3|s4|s5|s6|stm)\b", r"q_\1", stem).replace("FROM documents", "FROM asks")
    return f"""WITH msgs AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations),
        asks AS (SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:6], ' ') AS text FROM msgs),
        {docs}, {asked},
        q AS (SELECT doc_id AS ask, w, count(*) AS times FROM q_stm GROUP BY 1, 2),
        len_ AS (SELECT m.doc_id, m.doc_id // 1000 AS c, count(s.w) AS len FROM msgs m LEFT JOIN stm s USING (doc_id) GROUP BY 1, 2),
        avg_ AS (SELECT c, avg(len) AS a, count(*) AS n FROM len_ GROUP BY 1),
        tf AS (SELECT doc_id, doc_id // 1000 AS c, w, count(*) AS f FROM stm GROUP BY 1, 2, 3),
        df AS (SELECT c, w, count(*) AS d FROM tf GROUP BY 1, 2),
        bm AS (SELECT q.ask, tf.doc_id, sum(times * ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))) AS score
            FROM q JOIN tf ON tf.w = q.w AND tf.c = q.ask // 1000 JOIN df ON df.c = tf.c AND df.w = tf.w JOIN len_ l ON l.doc_id = tf.doc_id JOIN avg_ ON avg_.c = tf.c GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS k FROM bm WHERE score >= 0.01),
        h AS (SELECT m.doc_id, min(CASE WHEN k <= 10 THEN k END) AS k FROM msgs m LEFT JOIN r ON r.ask = m.doc_id AND r.doc_id = m.doc_id GROUP BY 1)
        SELECT round(avg(coalesce(CAST(1 AS DOUBLE) / k, 0)), 6) AS mrr, round(avg(CAST(coalesce(k <= 1, false) AS INT)), 6) AS r1, round(avg(CAST(coalesce(k <= 3, false) AS INT)), 6) AS r3 FROM h"""


def oracle_sql() -> dict[str, str]:
    from threadloom import queries as q

    tok = q._tok
    two = f"two AS (SELECT conv_id, CAST(sum({tok('text')}) AS BIGINT) AS tokens, sum(length(text)) AS chars, CAST(sum(CASE turn WHEN 0 THEN {tok('text')} END) AS BIGINT) AS first, CAST(sum(CASE turn WHEN 1 THEN {tok('text')} END) AS BIGINT) AS second FROM conversations WHERE turn < 2 GROUP BY 1), size AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)"
    zone = "z AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 OR turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS held FROM conversations)"
    hits = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0" for t in ("license", "under"))
    fmt = lambda n: f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} % 1000 IN (250, 750) THEN printf('%.1f', ({n} + 1) / 1000.0) || 'K' ELSE printf('%.1f', {n} / 1000.0) || 'K' END"
    pct = lambda n, t: f"CAST(CASE WHEN {n} <= 0 OR {t} <= 0 THEN 0 ELSE greatest(1, floor({n} * 100.0 / {t} + 0.5)) END AS BIGINT)"
    seen = f"""{q._TALK}, {q._blocks('talk')}, cov AS (SELECT DISTINCT conv_id, unnest(effective_message_ids) AS id FROM blk WHERE active),
        vis AS (SELECT t.conv_id, t.ord, 'm' || lpad(CAST(row_number() OVER (PARTITION BY t.conv_id ORDER BY t.ord) AS VARCHAR), 5, '0') AS ref, {tok('t.text')} AS tokens, cov.id IS NOT NULL AS held FROM talk t LEFT JOIN cov ON t.conv_id = cov.conv_id AND t.id = cov.id),
        v AS (SELECT * FROM vis WHERE NOT held AND tokens > 0),
        b AS (SELECT *, {tok('summary')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY compressed_tokens DESC, block_num) AS nth FROM blk WHERE active),
        sums AS (SELECT conv_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS s, CAST(sum(compressed_tokens) AS BIGINT) AS c, CAST(sum(CASE WHEN tier = 1 THEN s ELSE 0 END) AS BIGINT) AS s1, CAST(sum(CASE WHEN tier = 2 THEN s ELSE 0 END) AS BIGINT) AS s2 FROM b GROUP BY 1),
        txt AS (SELECT c.conv_id, coalesce(CAST(sum(v.tokens) AS BIGINT), 0) AS t, count(v.ref) AS n FROM (SELECT DISTINCT conv_id FROM talk) c LEFT JOIN v USING (conv_id) GROUP BY 1)"""
    tiers = f"CASE WHEN s1 > 0 AND s2 > 0 THEN 'T1: ' || {fmt('s1')} || ' | T2: ' || {fmt('s2')} END"
    return {
        "status_overview": f"""WITH {seen}, l AS (SELECT conv_id, string_agg('  ' || block_id || ' (T' || tier || ')  ' || {fmt('compressed_tokens')} || '→' || {fmt('s')} || '  2 msgs  "' || coalesce(topic, '(no topic)') || '"', chr(10) ORDER BY nth) AS lines FROM b GROUP BY 1),
            j AS (SELECT txt.conv_id, t, txt.n AS visible, coalesce(s, 0) AS s, c, sums.n AS blocks, lines, {tiers} AS tiers, t + coalesce(s, 0) AS total FROM txt LEFT JOIN sums USING (conv_id) LEFT JOIN l USING (conv_id))
            SELECT conv_id, 'CONTEXT BREAKDOWN' || chr(10) || '  0 tool (0%) | ' || {fmt('t')} || ' text (' || {pct('t', 'total')} || '%) | ' || {fmt('s')} || ' summaries (' || {pct('s', 'total')} || '%)' || chr(10)
                || CASE WHEN visible > 0 THEN '  Top tools: text (' || {pct('t', 'total')} || '%)' || chr(10) ELSE '' END || chr(10)
                || CASE WHEN blocks IS NULL THEN 'COMPRESSED BLOCKS' || chr(10) || '  No compressed blocks.' ELSE 'COMPRESSED BLOCKS — ' || blocks || ' active (' || {fmt('s')} || ' summary, ' || {fmt('c')} || ' original)' || coalesce(chr(10) || '  Tier usage: ' || tiers, '') || chr(10) || chr(10) || lines END
                || chr(10) || chr(10) || 'Tip: status_report(scope="messages", tool="' || CASE WHEN visible > 0 THEN 'text' ELSE 'bash' END || '") lists the messages' AS text FROM j""",
        "status_compressed": f"""WITH {seen}, f AS (SELECT * FROM b WHERE nth = 1), j AS (SELECT txt.conv_id, coalesce(sums.n, 0) AS n, coalesce(sums.s, 0) AS s, coalesce(c, 0) AS c, {tiers} AS tiers, f.block_id, f.tier, f.topic, f.compressed_tokens AS fc, f.s AS fs, f.direct_block_ids AS kids FROM txt LEFT JOIN sums USING (conv_id) LEFT JOIN f USING (conv_id))
            SELECT conv_id, 'COMPRESSED — ' || n || ' blocks | ' || {fmt('c')} || ' original → ' || {fmt('s')} || ' summary' || coalesce(chr(10) || 'Tier usage: ' || tiers, '') || chr(10)
                || coalesce(chr(10) || '  ' || block_id || ' (T' || tier || ')  ' || {fmt('fc')} || '→' || {fmt('fs')} || '  2 msgs  age=0 young' || CASE WHEN len(kids) > 0 THEN ' nested=[' || array_to_string(kids, ',') || ']' ELSE '' END || chr(10) || '    "' || coalesce(topic, '(no topic)') || '"', '')
                || CASE WHEN n > 1 THEN chr(10) || chr(10) || '1 of ' || n || ' shown.' ELSE '' END AS text FROM j""",
        "status_messages": f"""WITH {seen}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS k FROM v), l AS (SELECT conv_id, string_agg('  ' || ref || ' (' || {fmt('tokens')} || ') text', chr(10) ORDER BY k) AS lines FROM r WHERE k <= 3 GROUP BY 1)
            SELECT conv_id, 'UNCOMPRESSED — ' || {fmt('t')} || ' | ' || n || ' msgs' || chr(10) || 'Sorted by time' || chr(10) || coalesce(chr(10) || lines, '') || CASE WHEN n > 3 THEN chr(10) || chr(10) || '3 of ' || n || ' shown.' ELSE '' END AS text FROM txt LEFT JOIN l USING (conv_id)""",
        "status_ranges": f"""WITH {seen}, g AS (SELECT *, CAST(substr(ref, 2) AS INT) - row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS run FROM v), r AS (SELECT conv_id, run, min(ref) AS a, max(ref) AS z, count(*) AS k, CAST(sum(tokens) AS BIGINT) AS tokens FROM g GROUP BY 1, 2),
            l AS (SELECT conv_id, string_agg('  ' || CASE WHEN k = 1 THEN a ELSE a || '–' || z END || '  (' || k || ' msgs, ' || {fmt('tokens')} || CASE WHEN k > 1 THEN ' (' || CAST(floor(tokens * 1.0 / k + 0.5) AS BIGINT) || '/msg)' ELSE '' END || ') text', chr(10) ORDER BY a) AS lines FROM r GROUP BY 1)
            SELECT conv_id, 'UNCOMPRESSED — ' || {fmt('t')} || ' | ' || n || ' visible messages' || chr(10) || chr(10) || coalesce(lines, '  (no uncompressed messages)') AS text FROM txt LEFT JOIN l USING (conv_id)""",
        "nudge_reasons": f"""SELECT conv_id, CAST(token_count - growth AS BIGINT) AS reference, CAST(5000 AS BIGINT) AS step, CAST(2250 AS BIGINT) AS floor, token_count >= 55000 AS over_limit, token_count >= 98000 AS emergency,
            CASE WHEN tier IS NOT NULL AND pressure THEN 'tier ' || tier || ': usage ' || CAST(floor(token_count / 1000.0 + 0.5) AS BIGINT) || '%'
                 WHEN tier IS NOT NULL THEN 'tier ' || tier || ': ' || CASE tier WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END || ' tokens to gain'
                 WHEN pressure THEN 'nothing to gain at usage ' || CAST(floor(token_count / 1000.0 + 0.5) AS BIGINT) || '%'
                 WHEN greatest(t1, t2, t3) >= 5000 AND growth >= 2250 THEN 'no tier stands out'
                 ELSE concat_ws('; ', CASE WHEN greatest(t1, t2, t3) < 5000 THEN 'most to gain ' || greatest(t1, t2, t3) || ' below 5000' END, CASE WHEN growth < 2250 THEN 'growth ' || growth || ' below 2250' END) END AS reason
            FROM ({q._sql()["nudge_decision"]})""",
        "recap_texts": f"""WITH {q._TALK}, {q._blocks('talk')} SELECT conv_id, CASE WHEN count(*) FILTER (active) = 0 THEN 'No active compression blocks.' ELSE 'Active compression blocks (' || count(*) FILTER (active) || '):' || chr(10)
            || string_agg(chr(10) || block_id || ' | 2 messages | "' || coalesce(topic, '(none)') || '"' || chr(10) || '  ' || substr(summary, 1, 200) || CASE WHEN length(summary) > 200 THEN '...' ELSE '' END, chr(10) ORDER BY block_num) FILTER (active) || chr(10) || chr(10) || 'Name a block to get its full summary.' END AS text FROM blk GROUP BY 1""",
        "recap_block": f"""WITH {q._TALK}, {q._blocks('talk')}, w AS (SELECT *, '[Compressed conversation section]' || chr(10) || summary || chr(10) || chr(10) || '[' || block_id || ' | 2 messages | topic: "' || coalesce(topic, '(none)') || '"]' AS whole FROM blk)
            SELECT conv_id, CASE WHEN active THEN whole ELSE 'Block b1 is inactive: another block holds its content.' END AS text FROM w WHERE block_id = 'b1'
            UNION ALL SELECT conv_id, coalesce(max(CASE WHEN block_id = 'b3' THEN whole END), 'Block b3 not found. Active blocks: ' || string_agg(block_id, ', ' ORDER BY block_num) FILTER (active)) FROM w GROUP BY 1""",
        "tier_promotion": f"""WITH {two} SELECT conv_id, block_id, tier, active, start_ref, direct, 2 AS covers, children, CAST(coalesce(fixed, tokens) AS BIGINT) AS compressed_tokens FROM two,
            (VALUES ('b1', 1, false, 'm00001', 2, '', NULL), ('b2', 2, false, 'b1', 0, 'b1', 1), ('b3', 3, false, 'b2', 0, 'b2', 1), ('b4', 3, true, 'b3', 0, 'b3', 2)) v(block_id, tier, active, start_ref, direct, children, fixed)""",
        "resumed_calls": f"WITH {two} SELECT conv_id, 2 AS call, 1 AS created, CAST(1 AS BIGINT) AS tokens, tokens + 1 AS in_all, 3 AS next_block FROM two",
        "compress_gate": f"WITH {two} SELECT conv_id, CAST(chars >= {GATE} AS INT) AS created, CASE WHEN chars >= {GATE} THEN tokens ELSE 0 END AS tokens, CAST(chars < {GATE} AS INT) AS errors, 0 AS warnings FROM two",
        "summary_checks": "SELECT DISTINCT conv_id, CAST(conv_id % 100 BETWEEN 50 AND 80 AS INT) AS created, CAST(conv_id % 100 NOT BETWEEN 50 AND 80 AS INT) AS errors FROM conversations",
        "overlapping_specs": f"WITH {two} SELECT conv_id, CASE WHEN n >= 3 THEN 2 ELSE 1 END AS created, CASE WHEN n >= 3 THEN 1 ELSE 2 END AS errors, 1 AS warnings FROM size",
        "heir_snap": f"WITH {two} SELECT conv_id, call, created, errors, warnings FROM size, (VALUES (1, 1, 0, 0), (2, 1, 0, 0), (3, 1, 0, 2), (4, 0, 1, 0)) v(call, created, errors, warnings)",
        "livelock_guard": f"WITH {two} SELECT conv_id, call, created, CAST(CASE call WHEN 1 THEN first WHEN 2 THEN 0 ELSE second + 1 END AS BIGINT) AS tokens, errors FROM two, (VALUES (1, 1, 0), (2, 0, 1), (3, 1, 0)) v(call, created, errors)",
        "protected_compression": f"""WITH {q._SESS}, p AS (SELECT DISTINCT conv_id, tool_call_id FROM sess WHERE tool_name = 'bash'),
            f AS (SELECT s.* FROM sess s LEFT JOIN p ON s.conv_id = p.conv_id AND s.tool_call_id = p.tool_call_id WHERE coalesce(s.tool_name, '') <> 'bash' AND NOT (s.content_type = 'tool-result' AND p.conv_id IS NOT NULL))
            SELECT conv_id, CAST(count(*) AS INT) AS direct, CAST(count(*) AS INT) AS covers, CAST(sum({tok('text')}) AS BIGINT) AS compressed_tokens FROM f GROUP BY 1""",
        "recent_protection": f"""WITH {zone} SELECT conv_id, CAST(NOT bool_and(held) AS INT) AS created, CAST(coalesce(sum(CASE WHEN NOT held THEN {tok('text')} END), 0) AS BIGINT) AS tokens, CAST(bool_and(held) AS INT) AS errors, CAST(NOT bool_and(held) AS INT) AS warnings FROM z GROUP BY 1""",
        "turn_nudges": f"""WITH RECURSIVE c AS (SELECT conv_id, turn, count(*) OVER w AS messages, CAST(sum(ceil(length(text) / 4.0)) OVER w AS BIGINT) AS n, CAST(sum({tok('text')}) OVER w AS BIGINT) AS t1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            r AS (SELECT conv_id, turn, messages, n, CAST(0 AS BIGINT) AS growth, n AS baseline, CAST(0 AS BIGINT) AS last_shown, CAST(NULL AS INT) AS tier FROM c WHERE turn = 0
                UNION ALL SELECT c.conv_id, c.turn, c.messages, c.n, c.n - CASE WHEN r.last_shown > 0 THEN r.last_shown ELSE r.baseline END, r.baseline,
                    CASE WHEN c.n - CASE WHEN r.last_shown > 0 THEN r.last_shown ELSE r.baseline END >= 40 AND c.t1 >= 60 THEN c.n ELSE r.last_shown END,
                    CASE WHEN c.n - CASE WHEN r.last_shown > 0 THEN r.last_shown ELSE r.baseline END >= 40 AND c.t1 >= 60 THEN 1 END
                FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
            SELECT conv_id, turn AS request, messages, n AS token_count, growth, baseline, last_shown, tier FROM r""",
        "vanished_messages": """SELECT conv_id, request, active, lost FROM (SELECT DISTINCT conv_id FROM conversations),
            (VALUES (1, 'b1', ''), (2, '', 'b1'), (3, 'b1', '')) v(request, active, lost)""",
        "round_trip_texts": "SELECT conv_id, turn AS ord, text FROM conversations",
        "round_trip_openai": f"WITH {q._SESS} SELECT conv_id, content_type, CASE WHEN content_type <> 'reasoning' THEN count(*) END AS n, count(DISTINCT tool_call_id) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars FROM sess GROUP BY 1, 2",
        "state_store_updates": "SELECT 'c' || conv_id AS id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id",
        "state_store_legacy": "SELECT CASE conv_id % 4 WHEN 0 THEN 'sound' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'invalid' ELSE 'sound' END AS outcome, count(*) AS n, count(CASE WHEN conv_id % 4 <> 1 THEN 1 END) AS stamped FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1",
        "search_duplicates": f"""WITH l AS (SELECT doc_id % 50 AS ref, max(doc_id) AS last FROM documents GROUP BY 1), s AS (SELECT doc_id, doc_id % 50 AS ref, CAST({hits} AS DOUBLE) AS own FROM documents),
            w AS (SELECT s.doc_id, s.ref, own * CASE d.lang WHEN 'en' THEN 1.5 WHEN 'fr' THEN 1.0 ELSE 0.6 END AS score, CASE d.lang WHEN 'en' THEN 'user' WHEN 'fr' THEN 'assistant' ELSE 'tool' END AS role, d.text FROM s JOIN l USING (ref) JOIN documents d ON d.doc_id = l.last)
            SELECT doc_id, ref, round(score, 6) AS score, role, {q._preview(60, 'license under')} AS preview FROM w WHERE score >= 0.01 ORDER BY w.score DESC, doc_id LIMIT 20""",
        "bm25_indexed": f"WITH {q._BM} {q._top('bm')}",
        "semantic_topk": "WITH v AS (SELECT doc_id, " + ", ".join(f"length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{c}', '')) AS {c}" for c in "aeiou") + """ FROM documents),
            s AS (SELECT doc_id, CASE WHEN a + e + i + o + u = 0 THEN 0 ELSE (3 * a + 3 * e + i + o + u) / (sqrt(21.0) * sqrt(CAST(a * a + e * e + i * i + o * o + u * u AS DOUBLE))) END AS score FROM v)
            SELECT doc_id AS ref, round(score, 6) AS score FROM s WHERE score >= 0.01 ORDER BY s.score DESC, doc_id LIMIT 15""",
        "labelled_search": _labelled_sql(q._STEM),
        "tool_pair_widening": f"SELECT conv_id, 'b1' AS block_id, 'i0,i1,i2,i3,i4' AS direct, 5 * {tok('text')} AS compressed_tokens FROM conversations WHERE turn = 0",
        "reasoning_widening": f"SELECT conv_id, block_id, direct, n * {tok('text')} AS compressed_tokens FROM conversations, (VALUES ('b1', 'i0,i1,i2', 3), ('b2', 'i4,i5', 2), ('b3', 'i7', 1)) v(block_id, direct, n) WHERE turn = 0",
        "turn_filters": "SELECT conv_id, turn AS ord, CASE WHEN role = 'user' AND turn < max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) THEN '' ELSE replace(text, 'th', 'TH') END AS text FROM conversations",
        "request_kinds": "SELECT DISTINCT conv_id, CASE conv_id % 5 WHEN 0 THEN 'responses' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'anthropic' WHEN 3 THEN 'openai' END AS kind FROM conversations",
        "unreadable_requests": "SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 0 THEN 'no JSON' WHEN 2 THEN 'KeyError' ELSE 'TypeError' END AS error FROM conversations WHERE conv_id % 4 <> 1",
        "round_trip_responses": f"WITH {q._SESS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS ord, content_type, tool_call_id, CAST(length(text) AS INT) AS chars FROM sess WHERE content_type <> 'reasoning'",
        "viable_ranges": f"WITH RECURSIVE {q._SESS}, {q._refs('sess')}, {q._CLASS}, {q._FOLD} SELECT conv_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM rng WHERE tokens >= 700 GROUP BY 1",
        "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
            SELECT user_id, count(*) AS sessions, max(n) AS most, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY 1""",
        "block_listing": f"""WITH {q._TALK}, {q._blocks('talk')}, b AS (SELECT conv_id, block_id, block_num, compressed_tokens AS c, {tok('summary')} AS summary_tokens, conv_id * 3 - block_num AS created, block_num % 2 AS survived FROM blk WHERE active),
            r AS (SELECT conv_id, 'size' AS sort, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, created DESC, block_num) AS nth, block_id, summary_tokens FROM b
                UNION ALL SELECT conv_id, 'age', row_number() OVER (PARTITION BY conv_id ORDER BY survived DESC, block_num), block_id, summary_tokens FROM b
                UNION ALL SELECT conv_id, 'time', row_number() OVER (PARTITION BY conv_id ORDER BY created, block_num), block_id, summary_tokens FROM b)
            SELECT conv_id, sort, CAST(nth AS INT) AS nth, block_id, summary_tokens FROM r WHERE nth <= 2""",
        "message_listing_sorts": f"""WITH {q._SESS}, v AS (SELECT conv_id, ord, 'm' || lpad(CAST(ord + 1 AS VARCHAR), 5, '0') AS ref, {tok('text')} AS tokens, coalesce(tool_name, 'text') AS tool FROM sess WHERE length(text) > 0),
            r AS (SELECT conv_id, 'time' AS sort, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS nth, ref, tokens, tool FROM v
                UNION ALL SELECT conv_id, 'tool', row_number() OVER (PARTITION BY conv_id ORDER BY tool, tokens DESC, ord), ref, tokens, tool FROM v
                UNION ALL SELECT conv_id, 'size', row_number() OVER (PARTITION BY conv_id ORDER BY tokens DESC, ord), ref, tokens, tool FROM v WHERE tool = 'bash')
            SELECT conv_id, sort, CAST(nth AS INT) AS nth, ref, tokens, tool FROM r WHERE nth <= 4""",
        "search_by_group": "WITH " + _bm25_sql(q._STEM),
        "search_union": f"""WITH {two}, t AS (SELECT conv_id, 'message' AS kind, length(text) AS chars, length(role) + 2 + least(60, length(text)) AS titles FROM conversations UNION ALL SELECT conv_id, 'block', 8, 2 FROM size)
            SELECT conv_id, kind, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(titles) AS BIGINT) AS titles FROM t GROUP BY 1, 2""",
    }
