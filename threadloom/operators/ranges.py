"""What of a conversation may be compressed, and in which ranges.

Grouping depends on the running group (a user's message opens a new one only behind three), so it
is a fold over a conversation's ordered rows; ``aggregate`` keeps it in the JVM.  Everything else
is windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.functions.scalars import BLOCKED, SUMMARY_HEADER, count_tokens, is_protected, is_tool, never_recent, ref_number, utf16_length

from .coverage import covered

_RANGE = "struct<start_ref:string,end_ref:string,count:bigint,tokens:bigint,chars:bigint,tool_pct:bigint>"


def open_messages(messages: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Messages that no active block covers and that are no summaries."""
    rows = messages if blocks is None else messages.join(covered(blocks), ["conv_id", "id"], "left_anti")
    return rows.filter(~F.coalesce(F.col("text").startswith(SUMMARY_HEADER), F.lit(False)))


def protected_zone(messages: DataFrame, refs: DataFrame, config: Config, blocks: DataFrame | None = None) -> DataFrame:
    """(conv_id, ref) at a conversation's end that recommendations leave alone: the last messages, the
    last tokens, and the last user message."""
    rows = open_messages(messages, blocks).join(refs.select("conv_id", F.col("raw_id").alias("id"), "ref"), ["conv_id", "id"], "left")
    user = F.max(F.when(F.col("role") == "user", F.col("ord"))).over(Window.partitionBy("conv_id"))
    named = F.coalesce(F.col("ref") != BLOCKED, F.lit(False))
    rows = rows.withColumn("_user", F.coalesce(F.col("ord") == user, F.lit(False)) & named).withColumn("_in", named & ~never_recent())
    back = Window.partitionBy("conv_id").orderBy(F.desc("ord"))
    seen = F.sum(F.col("_in").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.coalesce(F.sum(F.when(F.col("_in"), count_tokens("text")).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_seen": seen, "_behind": behind})
    n, t = config.preserve_recent_messages, config.preserve_recent_tokens
    kept = F.lit(False)
    if n > 0:
        kept = kept | (F.col("_in") & (F.col("_seen") <= n)) | F.col("_user")
    if t > 0:
        kept = kept | (F.col("_in") & (F.col("_behind") < t))
    return rows.filter(kept).select("conv_id", "ref").distinct()


def _classified(messages: DataFrame, refs: DataFrame, config: Config, blocks: DataFrame | None) -> DataFrame:
    rows = open_messages(messages, blocks).join(refs.select("conv_id", F.col("raw_id").alias("id"), "ref"), ["conv_id", "id"])
    mine = is_protected(config.protected_tools)
    calls = messages.filter(mine & (F.col("content_type") == "tool-call") & (F.col("tool_call_id") != "")).select("conv_id", "tool_call_id").distinct().withColumn("_paired", F.lit(True))
    rows = rows.filter(F.col("ref") != BLOCKED).join(calls, ["conv_id", "tool_call_id"], "left")
    pair = F.coalesce((F.col("content_type") == "tool-result") & F.col("_paired"), F.lit(False))
    return rows.select("conv_id", "ord", "role", "tool_name", "ref", ref_number("ref").alias("num"), count_tokens("text").alias("tokens"), utf16_length("text").alias("chars"), is_tool().alias("tool"), (mine | pair).alias("protected"))


def compressible_ranges(messages: DataFrame, refs: DataFrame, config: Config, blocks: DataFrame | None = None, zone: DataFrame | None = None) -> DataFrame:
    """(conv_id, n, start_ref, end_ref, count, tokens, chars, tool_pct, text_pct), n from 0 in order."""
    rows = _classified(messages, refs, config, blocks).filter(~F.col("protected"))
    if zone is not None:
        rows = rows.join(zone, ["conv_id", "ref"], "left_anti")
    items = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ord", "ref", "num", "tokens", "chars", "tool", (F.col("role") == "user").alias("user")))).alias("m"))
    start = F.from_json(F.lit('{"done":[],"prev":-2}'), f"done array<{_RANGE}>, cur {_RANGE}, prev int")

    def step(acc, x):
        cur, hundred = acc["cur"], F.when(x["tool"], 100).otherwise(0).cast("long")
        cut = cur.isNotNull() & ((x["user"] & (cur["count"] >= 3)) | (x["num"] > acc["prev"] + 1))
        fresh = cur.isNull() | cut
        n = cur["count"] + 1
        share = F.floor((cur["tool_pct"] * cur["count"] + hundred) / n + 0.5)
        new = F.struct(x["ref"].alias("start_ref"), x["ref"].alias("end_ref"), F.lit(1).cast("long").alias("count"), x["tokens"].alias("tokens"), x["chars"].alias("chars"), hundred.alias("tool_pct"))
        more = F.struct(cur["start_ref"].alias("start_ref"), x["ref"].alias("end_ref"), n.alias("count"), (cur["tokens"] + x["tokens"]).alias("tokens"), (cur["chars"] + x["chars"]).alias("chars"), share.alias("tool_pct"))
        done = F.when(cut, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(fresh, new).otherwise(more).cast(_RANGE).alias("cur"), x["num"].alias("prev"))

    ranges = F.aggregate("m", start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    listed = items.select("conv_id", F.filter(ranges, lambda r: r["tokens"] > 0).alias("r"))
    return listed.select("conv_id", F.posexplode("r").alias("n", "g")).select("conv_id", "n", "g.*").withColumn("text_pct", 100 - F.col("tool_pct"))


def merged_ranges(ranges: DataFrame, least_chars: int) -> DataFrame:
    """Neighbouring ranges joined until each batch has ``least_chars``; the last may have fewer."""
    if least_chars <= 0:
        return ranges
    size = F.coalesce("chars", F.col("tokens") * 4)
    item = F.struct("n", "start_ref", "end_ref", "count", "tokens", size.alias("chars"), "tool_pct")
    per = ranges.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("sum"))

    def step(acc, x):
        total = acc["sum"] + x["chars"]
        full = total >= least_chars
        return F.struct(F.concat(acc["ids"], F.array(acc["batch"])).alias("ids"), F.when(full, acc["batch"] + 1).otherwise(acc["batch"]).alias("batch"), F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"))

    ids = F.aggregate("m", start, step, lambda acc: acc["ids"])
    rows = per.select("conv_id", F.explode(F.arrays_zip(ids.alias("batch"), F.col("m").alias("x"))).alias("z")).select("conv_id", F.col("z.batch").alias("batch"), "z.x.*")
    out = rows.groupBy("conv_id", "batch").agg(
        F.min_by("start_ref", "n").alias("start_ref"),
        F.max_by("end_ref", "n").alias("end_ref"),
        F.sum("count").alias("count"),
        F.sum("tokens").alias("tokens"),
        F.sum("chars").alias("chars"),
        F.floor(F.sum(F.col("tool_pct") * F.col("count")) / F.sum("count") + 0.5).alias("tool_pct"),
    )
    return out.withColumnRenamed("batch", "n").withColumn("text_pct", 100 - F.col("tool_pct"))


def protected_ranges(messages: DataFrame, refs: DataFrame, config: Config, blocks: DataFrame | None = None) -> DataFrame:
    """(conv_id, start_ref, end_ref, count, tokens, tools): runs of protected references."""
    rows = _classified(messages, refs, config, blocks).filter("protected")
    return islands(rows).groupBy("conv_id", "_g").agg(
        F.min_by("ref", "ord").alias("start_ref"),
        F.max_by("ref", "ord").alias("end_ref"),
        F.count("*").alias("count"),
        F.sum("tokens").alias("tokens"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("tool_name") != "", F.struct("ord", "tool_name")))), lambda s: s["tool_name"])).alias("tools"),
    ).drop("_g")


def islands(rows: DataFrame) -> DataFrame:
    """Rows with ``_g``, which a gap in ``num`` (by ``ord``) raises."""
    w = Window.partitionBy("conv_id").orderBy("ord")
    gap = F.coalesce((F.col("num") > F.lag("num").over(w) + 1).cast("int"), F.lit(0))
    return rows.withColumn("_gap", gap).withColumn("_g", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def viable(ranges: DataFrame, least_tokens: int = 200) -> DataFrame:
    return ranges.filter(F.col("tokens") >= least_tokens)


def accept_disjoint(spans: DataFrame) -> DataFrame:
    """``spans(conv_id, n, lo, hi)`` with ``accepted``: the earliest start wins, a span that begins at or
    before the end of an accepted one is left out and does not move that end."""
    per = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "hi"))).alias("m"))
    start = F.struct(F.array().cast("array<boolean>").alias("ok"), F.lit(-1).cast("long").alias("end"))

    def step(acc, x):
        fits = x["lo"] > acc["end"]
        return F.struct(F.concat(acc["ok"], F.array(fits)).alias("ok"), F.when(fits, F.greatest(acc["end"], x["hi"])).otherwise(acc["end"]).cast("long").alias("end"))

    ok = F.aggregate("m", start, step, lambda acc: acc["ok"])
    rows = per.select("conv_id", F.explode(F.arrays_zip(F.col("m").alias("x"), ok.alias("accepted"))).alias("z"))
    return rows.select("conv_id", "z.x.n", "z.x.lo", "z.x.hi", "z.accepted")


def listed_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges(conv_id, lo, hi, kind)`` joined where they touch or overlap, in order of their starts."""
    w = Window.partitionBy("conv_id").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", F.coalesce((F.col("lo") > top + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "_g").agg(F.min("lo").alias("lo"), F.max_by("hi", F.struct("lo", "hi")).alias("hi"), F.count("*").alias("parts")).drop("_g")


def uncompressed_runs(messages: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, start_ref, end_ref, count, tokens, tool): visible references in unbroken runs."""
    from .reports import visible_messages

    rows = visible_messages(messages, refs, blocks).withColumn("num", F.coalesce(F.regexp_extract("ref", "[0-9]+", 0).try_cast("int"), F.lit(0)))
    w = Window.partitionBy("conv_id").orderBy("ord")
    new = F.coalesce((F.col("num") != F.lag("num").over(w) + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "_g").agg(F.min_by("ref", "ord").alias("start_ref"), F.max_by("ref", "ord").alias("end_ref"), F.count("*").alias("count"), F.sum("tokens").alias("tokens"), F.min_by("tool", "ord").alias("tool")).drop("_g")


def truncation(messages: DataFrame, totals: DataFrame, config: Config, least: int = 1000, prefix: int = 2000, suffix: int = 2000, recent: int = 3) -> DataFrame:
    """Messages with large tool results cut until a conversation is below nine tenths of its threshold.

    ``totals(conv_id, token_count)``.  The largest go first; savings may be negative, so a cut is made
    while no shorter list of cuts was enough: the running *maximum* of the savings decides.
    """
    # A fixed value of the message format.
    mark = "[truncated for context space]"
    limit = config.truncate_threshold * config.model_context_limit
    n, text = count_tokens("text"), F.coalesce("text", F.lit(""))
    last = F.max("ord").over(Window.partitionBy("conv_id"))
    fits = (F.col("content_type") == "tool-result") & (F.col("ord") <= last - recent) & ~text.contains(mark) & (n >= least)
    cut = F.concat(F.substring(text, 1, prefix), F.lit(f"\n\n...{mark} — original ~"), n.cast("string"), F.lit(" tokens]...\n\n"), F.right(text, F.lit(suffix)))
    rows = messages.join(totals, "conv_id").filter(F.col("token_count") >= limit).withColumn("_fits", fits).filter("_fits")
    rows = rows.filter(F.length(text) > prefix + suffix).withColumns({"_n": n, "_cut": cut}).withColumn("_saves", F.col("_n") - count_tokens("_cut"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("_n"), "ord")
    total = F.coalesce(F.sum("_saves").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_total", total).withColumn("_best", F.max("_total").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("token_count") - F.col("_best") > limit * 0.9)
    return rows.select("conv_id", "ord", "id", F.col("_n").alias("tokens"), F.col("_saves").alias("saved"), F.col("_cut").alias("text"))
