"""Queries over the synthetic tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.config import Compress, Config, Nudge
from threadloom.functions import scalars as S
from threadloom.functions import text as X
from threadloom.operators import coverage, ranges, reports, search
from threadloom.plans import frames
from threadloom.sources import codecs, store
from threadloom.sources.tables import conversation_messages, read, sample_blocks, session_messages, store_root
from threadloom.streaming.turns import batch_turns

QUERY = "the license released under their token action token"
CONFIG = Config(model_context_limit=100_000, protected_tools=("bash",), preserve_recent_messages=2, preserve_recent_tokens=150, compress=Compress(1500, 0, 0), nudge=Nudge(0.55, 0.45, 0.05, 600, 50_000, 500, 0.45, 0.98), truncate_threshold=0.9)


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_messages(read(spark, sf_dir, "conversations"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_messages(read(spark, sf_dir, "events"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").alias("ref"), F.lit("message").alias("kind"), F.when(F.col("lang") == "en", "user").when(F.col("lang") == "fr", "assistant").otherwise("tool").alias("role"), "text")


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("ref", F.round("score", 6).alias("score"))


def token_count(spark, sf_dir):
    return _talk(spark, sf_dir).groupBy("conv_id").agg(F.sum(S.count_tokens("text")).alias("tokens"), F.sum(S.count_tokens_fast("text")).alias("fast"), F.sum(S.utf16_length("text")).alias("chars"))


def context_breakdown(spark, sf_dir):
    return reports.context_breakdown(_talk(spark, sf_dir).unionByName(_sessions(spark, sf_dir).withColumn("conv_id", F.col("conv_id") + 1_000_000)))


def content_ids(spark, sf_dir):
    return _sessions(spark, sf_dir).select("conv_id", "ord", "id", "content_type", S.message_kind().alias("kind"))


def assign_refs(spark, sf_dir):
    return coverage.assign_refs(_sessions(spark, sf_dir), patterns=("bash",))


def assign_refs_later(spark, sf_dir):
    """References of a second turn beside those of the first."""
    m = _sessions(spark, sf_dir)
    known = coverage.assign_refs(m.filter("ord < 10"), patterns=("ba*",))
    return coverage.assign_refs(m, known, patterns=("ba*",))


def protected_zone(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    return ranges.protected_zone(m, coverage.assign_refs(m, patterns=CONFIG.protected_tools), CONFIG)


def compressible_ranges(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    return ranges.compressible_ranges(m, coverage.assign_refs(m), CONFIG)


def merged_ranges(spark, sf_dir):
    return ranges.merged_ranges(compressible_ranges(spark, sf_dir), 1500)


def protected_ranges(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    out = ranges.protected_ranges(m, coverage.assign_refs(m), CONFIG)
    return out.withColumn("tools", F.array_join("tools", ","))


def sync_blocks(spark, sf_dir):
    m = _talk(spark, sf_dir)
    b = sample_blocks(m).withColumns({"survived_count": F.lit(4), "generation": F.lit("young")})
    return coverage.sync_blocks(m.filter("ord <> 3 and ord <> 4 or conv_id % 2 = 0"), b, 5).select("conv_id", "block_id", "active", "survived_count", "generation")


def prune_view(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return coverage.prune(m, sample_blocks(m)).select("conv_id", "ord", "id", "role", "text")


def orphan_strip(spark, sf_dir):
    return coverage.strip_orphans(_sessions(spark, sf_dir)).select("conv_id", "ord", "id")


def hide_compress_calls(spark, sf_dir):
    m = _sessions(spark, sf_dir).withColumn("tool_name", F.when(F.col("tool_name") == "read", "compress").otherwise(F.col("tool_name")))
    ids = m.select("conv_id").distinct()
    b = ids.select("conv_id", F.explode(F.array(F.struct(F.lit("c1").alias("compress_call_id"), F.lit(True).alias("active")), F.struct(F.lit("c2").alias("compress_call_id"), F.lit(False).alias("active")))).alias("b")).select("conv_id", "b.*")
    return coverage.hide_compress_calls(m, b).select("conv_id", "ord", "id")


def keep_last_filter(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    return coverage.keep_last(m, F.col("content_type") == "text").select("conv_id", "ord", F.length("text").alias("chars"))


def render_refs(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    return coverage.render_tags(m, coverage.assign_refs(m, patterns=("bash",))).select("conv_id", "ord", "text")


def system_hoist(spark, sf_dir):
    return coverage.leading_system(_talk(spark, sf_dir))


def role_runs(spark, sf_dir):
    return coverage.role_runs(_sessions(spark, sf_dir))


def blocks_overlapping(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return coverage.overlapping_blocks(sample_blocks(m), m.filter("ord = 2")).select("conv_id", "block_id", "tier")


def block_lineage(spark, sf_dir):
    return coverage.lineage(sample_blocks(_talk(spark, sf_dir)))


def active_below(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return coverage.active_below(sample_blocks(m).withColumn("active", F.lit(True)))


def deep_deactivate(spark, sf_dir):
    b = sample_blocks(_talk(spark, sf_dir)).withColumn("active", F.lit(True))
    return coverage.deactivate(b, b.filter("tier = 2"), deep=True).select("conv_id", "block_id", "active")


def block_content(spark, sf_dir):
    m = _talk(spark, sf_dir)
    b = sample_blocks(m).withColumn("active", F.lit(True))
    return coverage.block_content(m, b)


def restored_preview(spark, sf_dir):
    m = _talk(spark, sf_dir)
    b = sample_blocks(m)
    return coverage.restored_preview(m, b, b.withColumn("active", F.lit(False)))


def overlap_skip(spark, sf_dir):
    spans = read(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("n"), (F.col("event_id") % 997).alias("lo"))
    return ranges.accept_disjoint(spans.withColumn("hi", F.col("lo") + F.col("n") % 23))


def range_listing(spark, sf_dir):
    spans = read(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 997).alias("lo"), (F.col("event_id") % 997 + F.col("event_id") % 13).alias("hi"))
    return ranges.listed_ranges(spans)


def truncate_candidates(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    totals = m.groupBy("conv_id").agg((F.sum(S.count_tokens("text")) + 85_000).alias("token_count"))
    return ranges.truncation(m, totals, CONFIG, least=100, prefix=200, suffix=200).select("conv_id", "ord", "tokens", "saved", F.length("text").alias("chars"))


def visible_messages(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return reports.visible_messages(m, coverage.assign_refs(m), sample_blocks(m))


def uncompressed_runs(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return ranges.uncompressed_runs(m, coverage.assign_refs(m), sample_blocks(m))


def tool_group_topk(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    none = sample_blocks(m).limit(0)
    return reports.top_tools(reports.visible_messages(m, coverage.assign_refs(m, patterns=("none",)), none))


def message_listing(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    shown = reports.visible_messages(m, coverage.assign_refs(m), sample_blocks(m).limit(0))
    return reports.message_listing(shown, "size", 3)


def tier_usage(spark, sf_dir):
    return reports.tier_usage(sample_blocks(_talk(spark, sf_dir)))


def status_counts(spark, sf_dir):
    m = _talk(spark, sf_dir)
    totals = m.groupBy("conv_id").agg(F.sum(S.count_tokens("text")).alias("token_count"))
    return reports.status(sample_blocks(m), totals, CONFIG)


def block_recap(spark, sf_dir):
    return reports.recap(sample_blocks(_talk(spark, sf_dir)))


def nudge_decision(spark, sf_dir):
    m = _sessions(spark, sf_dir)
    merged = ranges.merged_ranges(ranges.compressible_ranges(m, coverage.assign_refs(m), CONFIG), 1500)
    pending = reports.pending_by_tier(merged, sample_blocks(m), 1500)
    turns = pending.withColumns({"token_count": F.col("conv_id") * 677 % 60_000 + 20, "baseline": F.col("conv_id") % 3 * 100, "last_shown": F.lit(0), "shown2": F.lit(0), "shown3": F.lit(0)})
    return reports.decide_nudge(turns, CONFIG).select("conv_id", "t1", "t2", "t3", "token_count", "growth", "pressure", "tier")


def refs_and_boundaries(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "b").when(F.col("event_id") % 3 == 1, " M00").otherwise("x"), F.col("event_id").cast("string")).alias("r"))
    return e.select("event_id", S.ref_to_index("r").alias("ref_index"), S.parse_boundary("r")["kind"].alias("kind"), S.parse_boundary("r")["number"].alias("number"), S.block_number(F.trim("r")).alias("block_number"), S.block_id_argument("r").alias("argument"), S.index_to_ref(F.col("event_id") % 90_000 + 1).alias("ref"))


def term_frequency(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return search.postings(docs).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def bm25_topk(spark, sf_dir):
    return _scored(search.top_k(search.bm25(_docs(spark, sf_dir), QUERY), 10))


def fuzzy_topk(spark, sf_dir):
    return _scored(search.top_k(search.fuzzy(_docs(spark, sf_dir), QUERY), 10))


def substring_topk(spark, sf_dir):
    return _scored(search.top_k(search.substring(_docs(spark, sf_dir), QUERY), 10))


def hybrid_topk(spark, sf_dir):
    return _scored(search.top_k(search.hybrid(_docs(spark, sf_dir), QUERY), 10))


def role_weighted_topk(spark, sf_dir):
    return search.search(_docs(spark, sf_dir), QUERY, preview_size=80).select("ref", F.round("score", 6).alias("score"), "role", "preview")


def cosine_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").filter("embedding is not null")
    one = F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one vector
    scored = rows.crossJoin(one).withColumn("score", S.cosine(F.col("embedding"), F.col("q")))
    return search.top_k(scored, 10, ties=("vec_id",)).select("vec_id", F.round("score", 6).alias("score"))


def legacy_search(spark, sf_dir):
    return search.legacy_search(sample_blocks(_talk(spark, sf_dir)), "start la the").select("conv_id", "block_id", F.round("score", 6).alias("score"))


def char_bigrams(spark, sf_dir):
    head = _docs(spark, sf_dir).select(F.explode(X.bigrams(F.lower("text"))).alias("gram"))
    return head.groupBy("gram").agg(F.count("*").alias("n"))


def ranking_quality(spark, sf_dir):
    """How well length ranks each source's first document."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("ref"), "n_chars")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "ref"))
    results = docs.withColumn("rank", rank).filter("rank <= 10")
    out = search.ranking_quality(results, docs.groupBy("query").agg(F.min("ref").alias("ref")))
    return out.select(*[F.round(c, 9).alias(c) for c in ("mrr", "r1", "r3")])


def turn_view(spark, sf_dir):
    """What a first turn sends: nothing is covered yet, so every message with its tag."""
    return frames.turns(_sessions(spark, sf_dir), CONFIG).select("conv_id", "ord", "text")


def turn_states(spark, sf_dir):
    return batch_turns(_talk(spark, sf_dir), CONFIG)


def rebuilt_blocks(spark, sf_dir):
    """Each conversation of four turns or more with a recorded call over its second and third message."""
    m = _talk(spark, sf_dir).withColumn("text", F.concat("text", F.repeat(F.lit(" pad"), 400)))
    last = m.groupBy("conv_id").agg(F.max("ord").alias("last")).filter("last >= 3")
    call = F.to_json(F.struct(F.array(F.struct(F.lit("m00002").alias("startId"), F.lit("m00003").alias("endId"), F.lit("what was said").alias("summary"))).alias("content")))
    calls = last.select("conv_id", (F.col("last") + 1).alias("ord"), F.lit("call").alias("id"), F.lit("assistant").alias("role"), F.lit("tool-call").alias("content_type"), call.alias("text"), F.lit("compress").alias("tool_name"), F.lit("k").alias("tool_call_id"))
    config = Config(model_context_limit=100_000, preserve_recent_messages=0, preserve_recent_tokens=0, compress=Compress(0, 0, 0))
    out = frames.rebuilt_blocks(m.join(last, "conv_id", "left_semi").unionByName(calls), config)
    return out.select("conv_id", "block_id", "tier", "active", F.size("direct_message_ids").alias("direct"), "start_ref", "end_ref", "compressed_tokens")


def _bodies(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    listed = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return rows.select("conv_id", F.to_json(F.struct(listed.alias("messages"))).alias("body"))


def codec_openai(spark, sf_dir):
    return codecs.flatten(_bodies(spark, sf_dir), "openai").select("conv_id", "ord", "id", "role", "text")


def codec_round_trip(spark, sf_dir):
    """Messages to the block format and back; runs of one side share a message there."""
    talk = _talk(spark, sf_dir)
    made = codecs.assemble(talk, "anthropic").withColumn("body", F.concat(F.lit('{"system":"","messages":'), "messages", F.lit("}")))
    return codecs.flatten(made, "anthropic").groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


def topic_heads(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return m.select("conv_id", "ord", S.topic_fallback("text").alias("topic"), S.percent(F.length("text"), F.lit(5000)).alias("share"), S.occurrences(F.lower("text"), "en").alias("hits"))


def session_identity(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 5)
    pick = lambda n, c: F.when(F.col("k") == n, F.concat(F.lit(" "), F.lit(c), F.col("user_id").cast("string"), F.lit(" "))).otherwise(F.lit("  "))
    out = e.select("event_id", codecs.identity(pick(0, "h"), pick(1, "s"), pick(2, "d"), pick(3, "p"), F.col("props")).alias("i"))
    return out.select("event_id", "i.*")


def subagent_namespaces(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("identity"), F.col("event_id").alias("arrival"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("instructions"))
    return codecs.subagents(e).select("identity", "arrival", "namespace")


def state_store(spark, sf_dir):
    """Statistics of each conversation, saved as state files and read back."""
    root = store_root(spark, "store")
    per = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("role").alias("role"))
    store.save(per.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.to_json(F.struct("turns", "role")).alias("payload")), root, now=1)
    return store.load(spark, root).select("id", "version", F.get_json_object("payload", "$.turns").cast("long").alias("turns"), F.get_json_object("payload", "$.role").alias("role"))


def queries() -> dict:
    from threadloom import queries_calls

    skip = {"queries", "oracle_sql"}
    return queries_calls.queries() | {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


_CJK = "[^\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]"


def _tok(c: str) -> str:
    k = f"length(regexp_replace(coalesce({c}, ''), '{_CJK}', '', 'g'))"
    return f"CAST({k} + ceil((length(coalesce({c}, '')) - {k}) / 4.0) AS BIGINT)"


def _ids(rows: str) -> str:
    return f"""
        SELECT conv_id, ord, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS id, role, content_type, text, tool_name, tool_call_id FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY ord) - 1 AS n FROM (
                SELECT *, 'h_' || substr(sha256(role || '|' || content_type || '|' || coalesce(tool_call_id, '') || '|' || coalesce(tool_name, '') || '|' || coalesce(text, '')), 1, 16) AS base FROM ({rows})))"""


_TALK = "talk AS (" + _ids("SELECT conv_id, turn AS ord, role, 'text' AS content_type, text, CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS tool_call_id FROM conversations") + ")"
_SESS = "sess AS (" + _ids("""
    SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
           CASE event_type WHEN 'view' THEN 'assistant' WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'assistant' ELSE 'tool' END AS role,
           CASE event_type WHEN 'view' THEN 'tool-call' WHEN 'purchase' THEN 'text' WHEN 'signup' THEN 'reasoning' ELSE 'tool-result' END AS content_type,
           repeat(props || ' ', CAST(trunc(value) AS BIGINT) + 1) AS text,
           CASE event_type WHEN 'view' THEN 'read' WHEN 'error' THEN 'bash' END AS tool_name,
           CASE WHEN event_type IN ('view', 'click', 'error') THEN 'c' || (CAST(regexp_extract(props, '[0-9]+') AS INT) % 10) END AS tool_call_id
    FROM events""") + ")"


def _blocks(src: str) -> str:
    return f"""blk AS (
        WITH four AS (
            SELECT conv_id, list(id ORDER BY ord) AS i, list(coalesce(text, '') ORDER BY ord) AS t FROM {src} WHERE ord BETWEEN 1 AND 4 AND conv_id IN (SELECT conv_id FROM {src} GROUP BY 1 HAVING max(ord) >= 5) GROUP BY 1 HAVING count(*) = 4)
        SELECT *, {_tok('summary')} * 10 AS compressed_tokens FROM (
            SELECT conv_id, 'b1' AS block_id, 1 AS block_num, 1 AS tier, 'start' AS topic, substr(t[1], 1, 80) || substr(t[2], 1, 80) AS summary, [i[1], i[2]] AS effective_message_ids, CAST([] AS VARCHAR[]) AS direct_block_ids, conv_id % 3 <> 0 AS active FROM four
            UNION ALL SELECT conv_id, 'b2', 2, 1, 'middle', substr(t[3], 1, 80) || substr(t[4], 1, 80), [i[3], i[4]], CAST([] AS VARCHAR[]), true FROM four
            UNION ALL SELECT conv_id, 'b3', 3, 2, NULL, substr(t[1], 1, 80) || substr(t[2], 1, 80), [i[1], i[2]], ['b1'], true FROM four WHERE conv_id % 3 = 0))"""


def _refs(src: str, blocked: str = "false", name: str = "refs") -> str:
    return f"""{name} AS (
        SELECT conv_id, id AS raw_id, CASE WHEN b THEN 'BLOCKED' ELSE 'm' || lpad(CAST(sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY ord) AS VARCHAR), 5, '0') END AS ref
        FROM (SELECT conv_id, id, ord, coalesce({blocked}, false) AS b FROM {src}))"""


_BASH = "content_type IN ('tool-call', 'tool-result') AND tool_name IN ('bash', 'compress')"
_CLASS = f"""cls AS (
    SELECT s.conv_id, s.ord, s.role, s.tool_name, r.ref, CAST(substr(r.ref, 2) AS INT) AS num, {_tok('s.text')} AS tokens, length(s.text) AS chars,
           s.content_type IN ('tool-call', 'tool-result') AS tool,
           coalesce(s.tool_name IN ('bash', 'compress') AND s.content_type IN ('tool-call', 'tool-result'), false)
             OR (s.content_type = 'tool-result' AND EXISTS (SELECT 1 FROM sess c WHERE c.conv_id = s.conv_id AND c.tool_call_id = s.tool_call_id AND c.content_type = 'tool-call' AND c.tool_name IN ('bash', 'compress'))) AS protected
    FROM sess s JOIN refs r ON r.conv_id = s.conv_id AND r.raw_id = s.id WHERE r.ref <> 'BLOCKED')"""
_FOLD = """rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS rn FROM cls WHERE NOT protected),
    fold AS (
        SELECT conv_id, rn, num, 0 AS g, 1 AS cnt, CAST(CASE WHEN tool THEN 100 ELSE 0 END AS BIGINT) AS pct, ref, tokens, chars FROM rows_ WHERE rn = 1
        UNION ALL
        SELECT x.conv_id, x.rn, x.num, CASE WHEN cut THEN g + 1 ELSE g END, CASE WHEN cut THEN 1 ELSE cnt + 1 END,
               CASE WHEN cut THEN h ELSE CAST(floor((pct * cnt + h) / CAST(cnt + 1 AS DOUBLE) + 0.5) AS BIGINT) END, x.ref, x.tokens, x.chars
        FROM (SELECT r.*, f.g, f.cnt, f.pct, (r.role = 'user' AND f.cnt >= 3) OR r.num > f.num + 1 AS cut, CAST(CASE WHEN r.tool THEN 100 ELSE 0 END AS BIGINT) AS h
              FROM fold f JOIN rows_ r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1) x),
    rng0 AS (SELECT conv_id, g, arg_min(ref, rn) AS start_ref, arg_max(ref, rn) AS end_ref, count(*) AS count, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars, arg_max(pct, rn) AS tool_pct FROM fold GROUP BY 1, 2),
    rng AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS INT) AS n, start_ref, end_ref, count, tokens, chars, tool_pct, 100 - tool_pct AS text_pct FROM rng0 WHERE tokens > 0)"""
_MERGE = """mb AS (
        SELECT conv_id, n, 0 AS b, CASE WHEN chars >= 1500 THEN 0 ELSE chars END AS s, chars >= 1500 AS full_ FROM rng WHERE n = 0
        UNION ALL
        SELECT r.conv_id, r.n, CASE WHEN m.full_ THEN m.b + 1 ELSE m.b END, CASE WHEN m.s + r.chars >= 1500 THEN 0 ELSE m.s + r.chars END, m.s + r.chars >= 1500 FROM mb m JOIN rng r ON r.conv_id = m.conv_id AND r.n = m.n + 1),
    mrg AS (SELECT conv_id, b AS n, arg_min(start_ref, n) AS start_ref, arg_max(end_ref, n) AS end_ref, CAST(sum(count) AS BIGINT) AS count, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars,
                   CAST(floor(sum(tool_pct * count) / CAST(sum(count) AS DOUBLE) + 0.5) AS BIGINT) AS tool_pct FROM mb JOIN rng USING (conv_id, n) GROUP BY 1, 2)"""
_VIS = f"""cov AS (SELECT DISTINCT conv_id, unnest(effective_message_ids) AS id FROM blk WHERE active),
    vis AS (SELECT t.conv_id, t.ord, r.ref, {_tok('t.text')} AS tokens, coalesce(t.tool_name, 'text') AS tool FROM talk t JOIN refs r ON r.conv_id = t.conv_id AND r.raw_id = t.id
            WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.conv_id = t.conv_id AND c.id = t.id) AND {_tok('t.text')} > 0)"""
_STEM = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_]*[a-z0-9]|[a-z0-9]')) AS w FROM documents),
    s1 AS (SELECT doc_id, length(w) > 3 AS l, CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%zes' OR w LIKE '%ches' OR w LIKE '%shes' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS w FROM tok WHERE length(w) >= 2),
    s2 AS (SELECT doc_id, l, CASE WHEN l AND w LIKE '%ing' AND length(w) > 5 THEN w[:-4] ELSE w END AS w FROM s1),
    s3 AS (SELECT doc_id, l, CASE WHEN l AND w LIKE '%ed' AND length(w) > 4 THEN w[:-3] ELSE w END AS w FROM s2),
    s4 AS (SELECT doc_id, l, CASE WHEN l AND w LIKE '%ation' AND length(w) > 6 THEN w[:-4] WHEN l AND w LIKE '%tion' AND length(w) > 5 THEN w[:-5] || 't' WHEN l AND w LIKE '%ion' AND length(w) > 4 THEN w[:-4] ELSE w END AS w FROM s3),
    s5 AS (SELECT doc_id, l, CASE WHEN l AND w LIKE '%ment' AND length(w) > 6 THEN w[:-5] ELSE w END AS w FROM s4),
    s6 AS (SELECT doc_id, l, CASE WHEN l AND w LIKE '%ness' AND length(w) > 6 THEN w[:-5] ELSE w END AS w FROM s5),
    stm AS (SELECT doc_id, CASE WHEN l AND w LIKE '%ly' AND length(w) > 4 THEN w[:-3] ELSE w END AS w FROM s6)"""


def _values(items: list[str]) -> str:
    return ", ".join(f"('{i}')" for i in items)


_BM = f"""{_STEM},
    q(w) AS (VALUES {_values(X.query_tokens(QUERY))}),
    len_ AS (SELECT d.doc_id, count(s.w) AS len FROM documents d LEFT JOIN stm s USING (doc_id) GROUP BY 1),
    avg_ AS (SELECT avg(len) AS a, count(*) AS n FROM len_),
    tf AS (SELECT doc_id, w, count(*) AS f FROM stm WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
    df AS (SELECT w, count(*) AS d FROM tf GROUP BY 1),
    bm AS (SELECT l.doc_id, coalesce(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))), 0) AS score
           FROM len_ l CROSS JOIN avg_ LEFT JOIN (tf JOIN q USING (w) JOIN df USING (w)) USING (doc_id) GROUP BY 1)"""
_GRAMS = X.query_bigrams(QUERY)
_FZ = "fz AS (SELECT doc_id, (" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{g}') AS INT)" for g in _GRAMS) + f") / {len(_GRAMS)}.0 AS score FROM documents)"
_HY = "hy AS (SELECT doc_id, 0.7 * bm.score / greatest((SELECT max(score) FROM bm), 1e-9) + 0.3 * fz.score / greatest((SELECT max(score) FROM fz), 1e-9) AS score FROM bm JOIN fz USING (doc_id))"


def _top(src: str, k: int = 10) -> str:
    return f"SELECT doc_id AS ref, round(score, 6) AS score FROM {src} WHERE score >= 0.01 ORDER BY {src}.score DESC, doc_id LIMIT {k}"


def _preview(size: int, query: str = QUERY) -> str:
    terms = [t for t in query.lower().split() if len(t) > 1]
    hit = "coalesce(" + ", ".join(f"nullif(strpos(lower(text), '{t}'), 0) - 1" for t in terms) + ", -1)"
    half = max(0, size // 2 - 10)
    return f"""(CASE WHEN {hit} < 0 THEN substr(text, 1, {size}) ELSE
        CASE WHEN greatest(0, {hit} - {half}) > 0 THEN '…' ELSE '' END
        || regexp_replace(substr(text, CAST(greatest(0, {hit} - {half}) + 1 AS BIGINT), {size}), '^\\s+|\\s+$', '', 'g')
        || CASE WHEN greatest(0, {hit} - {half}) + {size} < length(text) THEN '…' ELSE '' END END)"""


_RUNS = """SELECT conv_id, arg_min(ref, ord) AS start_ref, arg_max(ref, ord) AS end_ref, count(*) AS count, CAST(sum(tokens) AS BIGINT) AS tokens, arg_min(tool, ord) AS tool
    FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY ord) AS g FROM (
        SELECT *, CASE WHEN CAST(substr(ref, 2) AS INT) = lag(CAST(substr(ref, 2) AS INT)) OVER (PARTITION BY conv_id ORDER BY ord) + 1 THEN 0 ELSE 1 END AS new FROM vis)) GROUP BY conv_id, g"""
_LAB = "CASE WHEN x.topic IS NULL OR x.topic = '' THEN x.block_id ELSE x.block_id || ': ' || x.topic END"


def oracle_sql() -> dict[str, str]:
    out = _sql()
    out["turn_view"] = out["render_refs"]
    from threadloom import queries_calls

    return queries_calls.oracle_sql() | out


def _sql() -> dict[str, str]:
    strip = f"""WITH {_SESS}, a AS (SELECT * FROM sess s WHERE NOT (content_type = 'tool-call' AND tool_call_id IS NOT NULL AND coalesce(tool_name, '') <> 'compress'
            AND NOT EXISTS (SELECT 1 FROM sess r WHERE r.conv_id = s.conv_id AND r.content_type = 'tool-result' AND r.tool_call_id = s.tool_call_id))),
        b AS (SELECT * FROM a s WHERE NOT (content_type = 'tool-result' AND tool_call_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a c WHERE c.conv_id = s.conv_id AND c.content_type = 'tool-call' AND c.tool_call_id = s.tool_call_id))),
        n AS (SELECT *, (SELECT x.role || x.content_type FROM b x WHERE x.conv_id = b.conv_id AND x.ord > b.ord AND x.content_type <> 'reasoning' ORDER BY x.ord LIMIT 1) AS nxt FROM b)
        SELECT conv_id, ord, id FROM n WHERE content_type <> 'reasoning' OR coalesce(nxt IN ('assistanttext', 'assistanttool-call'), false)"""
    return {
        "token_count": f"SELECT conv_id, CAST(sum({_tok('text')}) AS BIGINT) AS tokens, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS fast, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
        "context_breakdown": f"""WITH {_TALK}, {_SESS}, a AS (SELECT * FROM talk UNION ALL SELECT * REPLACE (conv_id + 1000000 AS conv_id) FROM sess),
            k AS (SELECT conv_id, {_tok('text')} AS n, CASE WHEN starts_with(text, '[Compressed conversation section]') THEN 'summaries' WHEN content_type IN ('tool-call', 'tool-result') THEN 'tool' WHEN role = 'system' THEN 'system' WHEN contains(text, '```') THEN 'code' ELSE 'text' END AS s FROM a)
            SELECT conv_id, {', '.join(f"CAST(sum(CASE WHEN s = '{s}' THEN n ELSE 0 END) AS BIGINT) AS {s}" for s in ('system', 'tool', 'summaries', 'code', 'text'))}, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY 1""",
        "content_ids": f"WITH {_SESS} SELECT conv_id, ord, id, content_type, CASE WHEN content_type LIKE 'tool-%' THEN coalesce(tool_name, 'tool') ELSE content_type END AS kind FROM sess",
        "assign_refs": f"WITH {_SESS}, {_refs('sess', _BASH)} SELECT * FROM refs",
        "assign_refs_later": f"""WITH {_SESS}, old AS (SELECT * FROM sess WHERE ord < 10), new AS (SELECT * FROM sess WHERE ord >= 10), {_refs('old', _BASH, 'r1')}, {_refs('new', _BASH, 'r2')},
            top AS (SELECT conv_id, max(CASE WHEN ref = 'BLOCKED' THEN 0 ELSE CAST(substr(ref, 2) AS INT) END) AS t FROM r1 GROUP BY 1)
            SELECT * FROM r1 UNION ALL SELECT r2.conv_id, raw_id, CASE WHEN ref = 'BLOCKED' THEN ref ELSE 'm' || lpad(CAST(CAST(substr(ref, 2) AS INT) + t AS VARCHAR), 5, '0') END FROM r2 JOIN top USING (conv_id)""".replace("CASE WHEN ref = 'BLOCKED' THEN 0 ELSE CAST(substr(ref, 2) AS INT) END", "coalesce(TRY_CAST(substr(ref, 2) AS INT), 0)").replace("CAST(CAST(substr(ref, 2) AS INT) + t AS VARCHAR)", "CAST(TRY_CAST(substr(ref, 2) AS INT) + t AS VARCHAR)"),
        "protected_zone": f"""WITH {_SESS}, {_refs('sess', _BASH)},
            v AS (SELECT s.*, r.ref, {_tok('text')} AS n, r.ref <> 'BLOCKED' AND NOT coalesce(content_type IN ('tool-call', 'tool-result') AND tool_name IN ('decompress', 'search_context', 'read', 'bash'), false) AS inn,
                  ord = max(CASE WHEN role = 'user' THEN ord END) OVER (PARTITION BY s.conv_id) AS lastu FROM sess s JOIN refs r ON r.conv_id = s.conv_id AND r.raw_id = s.id),
            w AS (SELECT *, sum(CAST(inn AS INT)) OVER (PARTITION BY conv_id ORDER BY ord DESC) AS seen, coalesce(sum(CASE WHEN inn THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM v)
            SELECT DISTINCT conv_id, ref FROM w WHERE (inn AND (seen <= 2 OR behind < 150)) OR (coalesce(lastu, false) AND ref <> 'BLOCKED')""",
        "compressible_ranges": f"WITH RECURSIVE {_SESS}, {_refs('sess')}, {_CLASS}, {_FOLD} SELECT * FROM rng",
        "merged_ranges": f"WITH RECURSIVE {_SESS}, {_refs('sess')}, {_CLASS}, {_FOLD}, {_MERGE} SELECT *, 100 - tool_pct AS text_pct FROM mrg",
        "protected_ranges": f"""WITH {_SESS}, {_refs('sess')}, {_CLASS},
            p AS (SELECT *, num - row_number() OVER (PARTITION BY conv_id ORDER BY num) AS g FROM cls WHERE protected)
            SELECT conv_id, arg_min(ref, ord) AS start_ref, arg_max(ref, ord) AS end_ref, count(*) AS count, CAST(sum(tokens) AS BIGINT) AS tokens,
                   coalesce(list_aggregate(list_sort(list_distinct(list(tool_name) FILTER (tool_name IS NOT NULL))), 'string_agg', ','), '') AS tools FROM p GROUP BY conv_id, g""",
        "sync_blocks": f"""WITH {_TALK}, {_blocks('talk')}, m AS (SELECT * FROM talk WHERE (ord <> 3 AND ord <> 4) OR conv_id % 2 = 0),
            a AS (SELECT *, NOT EXISTS (SELECT 1 FROM blk p WHERE p.conv_id = b.conv_id AND list_contains(p.direct_block_ids, b.block_id)) AND EXISTS (SELECT 1 FROM m WHERE m.conv_id = b.conv_id AND list_contains(b.effective_message_ids, m.id)) AS act FROM blk b)
            SELECT conv_id, block_id, act AS active, CASE WHEN act THEN 5 ELSE 4 END AS survived_count, CASE WHEN act THEN 'old' ELSE 'young' END AS generation FROM a""",
        "prune_view": f"""WITH {_TALK}, {_blocks('talk')}, cov AS (SELECT DISTINCT conv_id, unnest(effective_message_ids) AS id FROM blk WHERE active),
            f AS (SELECT conv_id, min(ord) AS u FROM talk WHERE role = 'user' GROUP BY 1),
            k AS (SELECT t.conv_id, t.ord AS at_, 1 AS own, 0 AS nth, t.id, role, text FROM talk t LEFT JOIN f USING (conv_id) WHERE coalesce(t.ord = u, false) OR NOT EXISTS (SELECT 1 FROM cov WHERE cov.conv_id = t.conv_id AND cov.id = t.id)
                  UNION ALL SELECT b.conv_id, (SELECT min(ord) FROM talk t WHERE t.conv_id = b.conv_id AND list_contains(b.effective_message_ids, t.id)), 0, block_num, 'acp_summary_' || block_id, 'system',
                     '[Compressed conversation section]' || CASE WHEN topic IS NULL THEN '' ELSE ' — ' || topic END || CASE WHEN regexp_replace(summary, '^\\s+|\\s+$', '', 'g') = '' THEN '' ELSE chr(10) || regexp_replace(summary, '^\\s+|\\s+$', '', 'g') END FROM blk b WHERE active)
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY at_, own, nth) - 1 AS ord, id, role, text FROM k""",
        "orphan_strip": strip,
        "hide_compress_calls": f"""WITH {_SESS}, m AS (SELECT * REPLACE (CASE WHEN tool_name = 'read' THEN 'compress' ELSE tool_name END AS tool_name) FROM sess),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord DESC) AS rn FROM m WHERE tool_name = 'compress' AND content_type = 'tool-call' AND tool_call_id NOT IN ('c1', 'c2')),
            keep AS (SELECT DISTINCT conv_id, tool_call_id FROM o WHERE rn <= 2 UNION SELECT DISTINCT conv_id, 'c1' FROM m),
            hid AS (SELECT DISTINCT conv_id, tool_call_id FROM m WHERE tool_name = 'compress' AND content_type = 'tool-call' AND NOT EXISTS (SELECT 1 FROM keep k WHERE k.conv_id = m.conv_id AND k.tool_call_id = m.tool_call_id))
            SELECT conv_id, ord, id FROM m WHERE NOT (tool_call_id IS NOT NULL AND ((tool_name = 'compress' AND content_type = 'tool-call') OR content_type = 'tool-result') AND EXISTS (SELECT 1 FROM hid h WHERE h.conv_id = m.conv_id AND h.tool_call_id = m.tool_call_id))""",
        "keep_last_filter": f"WITH {_SESS} SELECT conv_id, ord, CASE WHEN content_type = 'text' AND ord < max(CASE WHEN content_type = 'text' THEN ord END) OVER (PARTITION BY conv_id) THEN 0 ELSE CAST(length(text) AS INT) END AS chars FROM sess",
        "render_refs": f"""WITH {_SESS}, {_refs('sess', _BASH)}, n AS (SELECT s.*, r.ref, {_tok('text')} AS n FROM sess s JOIN refs r ON r.conv_id = s.conv_id AND r.raw_id = s.id)
            SELECT conv_id, ord, CASE WHEN ref = 'BLOCKED' THEN text ELSE '<acp tokens="' || CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE CAST(CAST(floor(floor(n / 100.0 + 0.5) / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(floor(n / 100.0 + 0.5) AS BIGINT) % 10 AS VARCHAR) || 'K' END
                || '" type="' || CASE WHEN content_type LIKE 'tool-%' THEN coalesce(tool_name, 'tool') ELSE content_type END || '">' || ref || '</acp>' || chr(10) || text END AS text FROM n""",
        "system_hoist": f"WITH {_TALK}, n AS (SELECT *, sum(CAST(role <> 'system' AS INT)) OVER (PARTITION BY conv_id ORDER BY ord) AS k FROM talk) SELECT conv_id, string_agg(text, chr(10) ORDER BY ord) AS system FROM n WHERE k = 0 GROUP BY 1",
        "role_runs": f"""WITH {_SESS}, n AS (SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY conv_id ORDER BY ord) THEN 1 ELSE 0 END AS c FROM sess),
            g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY ord) AS run FROM n) SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS parts FROM g GROUP BY 1, 2""",
        "blocks_overlapping": f"WITH {_TALK}, {_blocks('talk')} SELECT conv_id, block_id, tier FROM blk b WHERE active AND EXISTS (SELECT 1 FROM talk t WHERE t.conv_id = b.conv_id AND t.ord = 2 AND list_contains(b.effective_message_ids, t.id))",
        "block_lineage": f"""WITH RECURSIVE {_TALK}, {_blocks('talk')}, e AS (SELECT conv_id, block_id, unnest(direct_block_ids) AS below FROM blk),
            r AS (SELECT *, 1 AS depth FROM e UNION SELECT r.conv_id, r.block_id, e.below, depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.block_id = r.below WHERE depth < 64)
            SELECT conv_id, block_id, below, min(depth) AS depth FROM r GROUP BY 1, 2, 3""",
        "active_below": f"WITH {_TALK}, {_blocks('talk')} SELECT conv_id, block_id, 'b1' AS owner FROM blk WHERE tier = 2",
        "deep_deactivate": f"WITH {_TALK}, {_blocks('talk')} SELECT conv_id, block_id, NOT (tier = 2 OR (block_id = 'b1' AND conv_id % 3 = 0)) AS active FROM blk",
        "block_content": f"""WITH {_TALK}, {_blocks('talk')}, inner_ AS (SELECT p.conv_id, p.block_id AS pid, x.* EXCLUDE (conv_id) FROM (SELECT conv_id, block_id, unnest(direct_block_ids) AS c FROM blk) p JOIN blk x ON x.conv_id = p.conv_id AND x.block_id = p.c),
            own AS (SELECT DISTINCT conv_id, block_id, unnest(effective_message_ids) AS id FROM blk), gone AS (SELECT DISTINCT conv_id, pid AS block_id, unnest(effective_message_ids) AS id FROM inner_),
            p AS (SELECT o.conv_id, o.block_id, 1 AS g, t.ord AS n, '[' || role || ']' || chr(10) || text AS t FROM own o JOIN talk t ON t.conv_id = o.conv_id AND t.id = o.id WHERE NOT EXISTS (SELECT 1 FROM gone z WHERE z.conv_id = o.conv_id AND z.block_id = o.block_id AND z.id = o.id)
                  UNION ALL SELECT x.conv_id, pid, 0, 0, '[Compressed conversation section] — ' || {_LAB} || chr(10) || x.summary FROM inner_ x)
            SELECT conv_id, block_id, count(*) AS items, string_agg(t, chr(10) || chr(10) ORDER BY g, n) AS content FROM p GROUP BY 1, 2""",
        "restored_preview": f"""WITH {_TALK}, {_blocks('talk')}, cov AS (SELECT DISTINCT conv_id, unnest(effective_message_ids) AS id FROM blk WHERE active),
            l AS (SELECT t.conv_id, t.ord, '[' || role || '] ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS line FROM talk t JOIN cov USING (conv_id, id)),
            w AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
            SELECT conv_id, count(*) AS restored, string_agg(line, chr(10) ORDER BY ord) FILTER (s < 2000) AS preview FROM w GROUP BY 1""",
        "overlap_skip": """WITH RECURSIVE s AS (SELECT user_id AS conv_id, event_id AS n, event_id % 997 AS lo, event_id % 997 + event_id % 23 AS hi, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 997, event_id) AS rn FROM events),
            f AS (SELECT conv_id, n, lo, hi, rn, true AS accepted, hi AS e FROM s WHERE rn = 1
                  UNION ALL SELECT s.conv_id, s.n, s.lo, s.hi, s.rn, s.lo > f.e, CASE WHEN s.lo > f.e THEN greatest(f.e, s.hi) ELSE f.e END FROM f JOIN s ON s.conv_id = f.conv_id AND s.rn = f.rn + 1)
            SELECT conv_id, n, lo, hi, accepted FROM f""",
        "range_listing": """WITH s AS (SELECT user_id AS conv_id, event_id % 997 AS lo, event_id % 997 + event_id % 13 AS hi FROM events),
            n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY conv_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS c FROM s),
            g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM n)
            SELECT conv_id, min(lo) AS lo, arg_max(hi, struct_pack(a := lo, b := hi)) AS hi, count(*) AS parts FROM g GROUP BY conv_id, g""",
        "truncate_candidates": f"""WITH {_SESS}, tot AS (SELECT conv_id, sum({_tok('text')}) + 85000 AS tc, max(ord) AS last FROM sess GROUP BY 1),
            c AS (SELECT s.conv_id, s.ord, {_tok('text')} AS n, tc, substr(text, 1, 200) || chr(10) || chr(10) || '...[truncated for context space] — original ~' || {_tok('text')} || ' tokens]...' || chr(10) || chr(10) || right(text, 200) AS cut
                  FROM sess s JOIN tot USING (conv_id) WHERE tc >= 90000.0 AND content_type = 'tool-result' AND s.ord <= last - 3 AND {_tok('text')} >= 100 AND length(text) > 400),
            v AS (SELECT *, n - {_tok('cut')} AS saved FROM c),
            t AS (SELECT *, coalesce(sum(saved) OVER (PARTITION BY conv_id ORDER BY n DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM v),
            b AS (SELECT *, max(total) OVER (PARTITION BY conv_id ORDER BY n DESC, ord ROWS UNBOUNDED PRECEDING) AS best FROM t)
            SELECT conv_id, ord, n AS tokens, saved, CAST(length(cut) AS INT) AS chars FROM b WHERE tc - best > 81000.0""",
        "visible_messages": f"WITH {_TALK}, {_blocks('talk')}, {_refs('talk')}, {_VIS} SELECT * FROM vis",
        "uncompressed_runs": f"WITH {_TALK}, {_blocks('talk')}, {_refs('talk')}, {_VIS} {_RUNS}",
        "tool_group_topk": f"""WITH {_SESS}, g AS (SELECT conv_id, coalesce(tool_name, 'text') AS tool, CAST(sum({_tok('text')}) AS BIGINT) AS tokens, count(*) AS messages FROM sess GROUP BY 1, 2),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY tokens DESC, tool) AS INT) AS nth FROM g) SELECT * FROM r WHERE nth <= 3""",
        "message_listing": f"""WITH {_SESS}, {_refs('sess')}, v AS (SELECT s.conv_id, s.ord, r.ref, {_tok('text')} AS tokens, coalesce(tool_name, 'text') AS tool FROM sess s JOIN refs r ON r.conv_id = s.conv_id AND r.raw_id = s.id),
            n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY tokens DESC, ord) AS INT) AS nth FROM v) SELECT * FROM n WHERE nth <= 3""",
        "tier_usage": f"WITH {_TALK}, {_blocks('talk')}, g AS (SELECT conv_id, tier, count(*) AS blocks, CAST(sum({_tok('summary')}) AS BIGINT) AS tokens FROM blk WHERE active GROUP BY 1, 2) SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY conv_id) >= 2",
        "status_counts": f"""WITH {_TALK}, {_blocks('talk')}, t AS (SELECT conv_id, CAST(sum({_tok('text')}) AS BIGINT) AS token_count FROM talk GROUP BY 1),
            b AS (SELECT conv_id, count(*) FILTER (active) AS a, count(*) AS n, CAST(sum(compressed_tokens) AS BIGINT) AS c FROM blk GROUP BY 1)
            SELECT conv_id, token_count, coalesce(a, 0) AS active_blocks, coalesce(n, 0) AS total_blocks, coalesce(c, 0) AS tokens_compressed, token_count / 100000.0 AS context_usage FROM t LEFT JOIN b USING (conv_id)""".replace("token_count / 100000.0", "CAST(token_count AS DOUBLE) / 100000"),
        "block_recap": f"WITH {_TALK}, {_blocks('talk')} SELECT conv_id, block_id, block_num, tier, substr(summary, 1, 200) AS head FROM blk WHERE active",
        "nudge_decision": f"""WITH RECURSIVE {_SESS}, {_refs('sess')}, {_CLASS}, {_FOLD}, {_MERGE}, {_blocks('sess')},
            o AS (SELECT conv_id, sum(tokens) AS t1 FROM mrg WHERE chars >= 1500 GROUP BY 1),
            r AS (SELECT conv_id, sum(CASE WHEN tier = 1 THEN {_tok('summary')} ELSE 0 END) AS t2, sum(CASE WHEN tier = 2 THEN {_tok('summary')} ELSE 0 END) AS t3 FROM blk WHERE active GROUP BY 1),
            p AS (SELECT conv_id, CAST(coalesce(t1, 0) AS BIGINT) AS t1, CAST(coalesce(t2, 0) AS BIGINT) AS t2, CAST(coalesce(t3, 0) AS BIGINT) AS t3, conv_id * 677 % 60000 + 20 AS token_count, conv_id % 3 * 100 AS baseline FROM o FULL JOIN r USING (conv_id)),
            q AS (SELECT *, token_count - CASE WHEN baseline > 0 THEN baseline ELSE token_count END AS growth, token_count / 100000.0 >= 0.55 AS pressure FROM p)
            SELECT conv_id, t1, t2, t3, token_count, growth, pressure, CAST(CASE WHEN pressure THEN CASE WHEN greatest(t1, t2, t3) <= 0 THEN NULL WHEN t1 = greatest(t1, t2, t3) THEN 1 WHEN t2 = greatest(t1, t2, t3) THEN 2 ELSE 3 END
                WHEN growth >= 2250 THEN CASE WHEN t1 >= 5000 THEN 1 WHEN t2 >= 7500 AND t2 > t1 THEN 2 WHEN t3 >= 7500 AND t3 > t2 AND t3 > t1 THEN 3 END END AS INT) AS tier FROM q""",
        "refs_and_boundaries": """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN ' M00' ELSE 'x' END || event_id AS r FROM events),
            d AS (SELECT event_id, TRY_CAST(nullif(regexp_extract(lower(trim(r)), '^m0*(\\d{1,5})$', 1), '') AS INT) AS m, TRY_CAST(nullif(regexp_extract(lower(trim(r)), '^b(\\d{1,9})$', 1), '') AS INT) AS b FROM e)
            SELECT event_id, CASE WHEN m BETWEEN 1 AND 99999 THEN m END AS ref_index, CASE WHEN m BETWEEN 1 AND 99999 THEN 'message' WHEN b >= 1 THEN 'block' END AS kind, CASE WHEN m BETWEEN 1 AND 99999 THEN m WHEN b >= 1 THEN b END AS number,
                   coalesce(b, 0) AS block_number, CASE WHEN b IS NOT NULL THEN 'b' || b END AS argument, 'm' || lpad(CAST(event_id % 90000 + 1 AS VARCHAR), 5, '0') AS ref FROM d""",
        "term_frequency": f"WITH {_STEM}, t AS (SELECT doc_id, w, count(*) AS f FROM stm GROUP BY 1, 2) SELECT w AS term, CAST(sum(f) AS BIGINT) AS tf, count(*) AS df FROM t GROUP BY 1",
        "bm25_topk": f"WITH {_BM} {_top('bm')}",
        "fuzzy_topk": f"WITH {_FZ} {_top('fz')}",
        "substring_topk": "WITH sb AS (SELECT doc_id, CAST(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0" for t in QUERY.lower().split()) + f" AS DOUBLE) AS score FROM documents) {_top('sb')}",
        "hybrid_topk": f"WITH {_BM}, {_FZ}, {_HY} {_top('hy')}",
        "role_weighted_topk": f"""WITH {_BM}, {_FZ}, {_HY}, w AS (SELECT doc_id, score * CASE lang WHEN 'en' THEN 1.5 WHEN 'fr' THEN 1.0 ELSE 0.6 END AS score, CASE lang WHEN 'en' THEN 'user' WHEN 'fr' THEN 'assistant' ELSE 'tool' END AS role, text FROM hy JOIN documents USING (doc_id))
            SELECT doc_id AS ref, round(score, 6) AS score, role, {_preview(80)} AS preview FROM w WHERE score >= 0.01 ORDER BY w.score DESC, doc_id LIMIT 10""",
        "cosine_topk": "WITH s AS (SELECT d.vec_id AS doc_id, list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings d, embeddings q WHERE q.vec_id = 0) SELECT doc_id AS vec_id, round(score, 6) AS score FROM s WHERE score >= 0.01 ORDER BY s.score DESC, doc_id LIMIT 10",
        "legacy_search": f"""WITH {_TALK}, {_blocks('talk')}, s AS (SELECT conv_id, block_id, least(1.0, {' + '.join(f"least(0.45, 0.15 * (length(coalesce(topic, '')) - length(replace(lower(coalesce(topic, '')), '{t}', ''))) / {len(t)}) + least(0.2, 0.04 * (length(summary) - length(replace(lower(summary), '{t}', ''))) / {len(t)})" for t in ('start', 'la', 'the'))}) AS score FROM blk WHERE active)
            SELECT conv_id, block_id, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score > 0.1""",
        "char_bigrams": "WITH p AS (SELECT substr(lower(text), i, 2) AS gram FROM documents, LATERAL (SELECT unnest(range(1, length(text))) AS i)) SELECT gram, count(*) AS n FROM p WHERE length(gram) = 2 AND NOT regexp_matches(gram, '^\\s|\\s$') GROUP BY 1",
        "ranking_quality": """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k, min(doc_id) OVER (PARTITION BY source) AS f FROM documents),
            h AS (SELECT source, min(CASE WHEN k <= 10 THEN k END) AS k FROM r WHERE doc_id = f GROUP BY 1)
            SELECT round(avg(coalesce(CAST(1 AS DOUBLE) / k, 0)), 9) AS mrr, round(avg(CAST(coalesce(k <= 1, false) AS INT)), 9) AS r1, round(avg(CAST(coalesce(k <= 3, false) AS INT)), 9) AS r3 FROM h""",
        "turn_states": "SELECT conv_id, count(*) AS messages, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS token_count, count(*) AS refs, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS baseline, CAST(NULL AS INT) AS tier FROM conversations GROUP BY 1",
        "rebuilt_blocks": f"""WITH l AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) >= 3), t AS (SELECT conv_id, text || repeat(' pad', 400) AS text FROM conversations JOIN l USING (conv_id) WHERE turn IN (1, 2))
            SELECT conv_id, 'b1' AS block_id, 1 AS tier, true AS active, CAST(count(*) AS INT) AS direct, 'm00002' AS start_ref, 'm00003' AS end_ref, CAST(sum({_tok('text')}) AS BIGINT) AS compressed_tokens FROM t GROUP BY 1""",
        "codec_openai": f"""WITH k AS (SELECT *, sum(CAST(role <> 'system' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
            h AS ({_ids("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role, 'text' AS content_type, text, CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS tool_call_id FROM k WHERE n > 0")})
            SELECT conv_id, ord, id, role, text FROM h""",
        "codec_round_trip": "SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
        "topic_heads": f"""WITH {_TALK}, t AS (SELECT conv_id, ord, text, trim(regexp_replace(regexp_split_to_array(text, '[.\\n]')[1], '["''`]', '', 'g')) AS f FROM talk)
            SELECT conv_id, ord, CASE WHEN length(f) > 30 THEN substr(f, 1, 30) || '…' ELSE f END AS topic, CAST(greatest(1, floor(length(text) / 50.0 + 0.5)) AS INT) AS share, CAST((length(text) - length(replace(lower(text), 'en', ''))) / 2 AS INT) AS hits FROM t""",
        "session_identity": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'h' || user_id WHEN 1 THEN 's' || user_id WHEN 2 THEN 'd' || user_id WHEN 3 THEN 'p' || user_id ELSE substr(sha256(props), 1, 16) END AS value,
            CASE event_id % 5 WHEN 0 THEN 'header' WHEN 1 THEN 'body-session' WHEN 2 THEN 'metadata-session' WHEN 3 THEN 'previous-response' ELSE 'content-fingerprint' END AS source, event_id % 5 < 3 AS client_provided FROM events""",
        "subagent_namespaces": """WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS t FROM events WHERE event_type <> 'view' GROUP BY 1)
            SELECT CAST(e.user_id AS VARCHAR) AS identity, event_id AS arrival, CASE WHEN event_type = 'view' OR event_type = t THEN CAST(e.user_id AS VARCHAR) ELSE e.user_id || '|sub:' || substr(sha256(event_type), 1, 16) END AS namespace FROM events e LEFT JOIN f USING (user_id)""",
        "state_store": "SELECT 'c' || conv_id AS id, 2 AS version, count(*) AS turns, max(role) AS role FROM conversations GROUP BY conv_id",
    }
