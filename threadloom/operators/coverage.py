"""References, coverage of messages by blocks, and the pruned view.

Every join is on (conv_id, id): a conversation is at most some thousand rows, conversations are
many, so keys spread; blocks are exploded once and met by semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.tables import written
from threadloom.functions.scalars import (
    BLOCKED,
    SUMMARY_HEADER,
    SUMMARY_PREFIX,
    count_tokens,
    index_to_ref,
    is_protected,
    is_tool,
    message_kind,
    ref_number,
    rendered_summary,
)


def assign_refs(messages: DataFrame, refs: DataFrame | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, raw_id, ref): known references and one for each new id, in order of first sight.

    Protected tool messages get ``BLOCKED`` and use no number, if any pattern is given; empty ids get
    none.
    """
    first = messages.filter("id is not null and id <> ''").groupBy("conv_id", "id").agg(F.min_by(F.struct("ord", "tool_name", "content_type"), "ord").alias("m"))
    first = first.select("conv_id", F.col("id").alias("raw_id"), "m.*")
    blocked = is_protected(patterns) if patterns else F.lit(False)
    if refs is None:
        fresh, base = first, F.lit(0)
    else:
        top = refs.filter(F.col("ref") != BLOCKED).groupBy("conv_id").agg(F.max(ref_number("ref")).alias("_top"))
        fresh = first.join(refs.select("conv_id", "raw_id"), ["conv_id", "raw_id"], "left_anti").join(top, "conv_id", "left")
        base = F.coalesce("_top", F.lit(0))
    fresh = fresh.withColumn("_blocked", blocked)
    nth = F.sum(F.when(F.col("_blocked"), 0).otherwise(1)).over(Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    made = fresh.select("conv_id", "raw_id", F.when(F.col("_blocked"), BLOCKED).otherwise(index_to_ref(nth + base)).alias("ref"))
    return made if refs is None else refs.select("conv_id", "raw_id", "ref").unionByName(made)


def covered(blocks: DataFrame) -> DataFrame:
    """(conv_id, id) that active blocks cover, once each."""
    return blocks.filter("active").select("conv_id", F.explode("effective_message_ids").alias("id")).distinct()


def visible(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    return messages.join(covered(blocks), ["conv_id", "id"], "left_anti")


def sync_blocks(messages: DataFrame, blocks: DataFrame, promote_at: int | None = None) -> DataFrame:
    """Blocks with ``active`` recomputed: no other block holds it, and a message or its rendered
    summary is there.  With ``promote_at``, active ones age and turn old at that count."""
    held = blocks.select("conv_id", F.explode("direct_block_ids").alias("block_id")).distinct().withColumn("_held", F.lit(True))
    present = messages.select("conv_id", "id").distinct()
    shown = blocks.select("conv_id", "block_id", F.explode(F.concat("effective_message_ids", F.array(F.concat(F.lit(SUMMARY_PREFIX), "block_id")))).alias("id"))
    shown = shown.join(present, ["conv_id", "id"], "left_semi").select("conv_id", "block_id").distinct().withColumn("_shown", F.lit(True))
    out = blocks.join(held, ["conv_id", "block_id"], "left").join(shown, ["conv_id", "block_id"], "left")
    out = out.withColumn("active", F.col("_held").isNull() & F.col("_shown").isNotNull()).drop("_held", "_shown")
    return advance_survival(out, promote_at) if promote_at is not None else out


def advance_survival(blocks: DataFrame, promote_at: int) -> DataFrame:
    count = F.col("survived_count") + F.col("active").cast("int")
    old = F.when(F.col("active") & (count >= promote_at), "old").otherwise(F.col("generation"))
    return blocks.withColumn("generation", old).withColumn("survived_count", count)


def prune(messages: DataFrame, blocks: DataFrame, inject: bool = True, strip: bool = True) -> DataFrame:
    """The view that is sent: covered messages go except the first user's, each active block's summary
    stands where its first message was (or where it already stands), orphans go; ``ord`` is new.

    A conversation without coverage stays as it is, orphans too.
    """
    first_user = messages.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("ord"))).alias("_first"))
    gone = covered(blocks).withColumn("_gone", F.lit(True))
    touched = gone.select("conv_id").distinct().withColumn("_touched", F.lit(True))
    active = blocks.filter("active")
    summaries = active.select("conv_id", F.concat(F.lit(SUMMARY_PREFIX), "block_id").alias("id")).withColumn("_stale", F.lit(inject))
    marked = messages.join(gone, ["conv_id", "id"], "left").join(touched, "conv_id", "left").join(first_user, "conv_id", "left").join(summaries, ["conv_id", "id"], "left")
    stale = F.coalesce(F.col("_stale") & rendered_summary(), F.lit(False))
    kept = marked.filter(F.col("_touched").isNull() | F.coalesce(F.col("ord") == F.col("_first"), F.lit(False)) | (F.col("_gone").isNull() & ~stale))
    shape = ["conv_id", "id", "role", "content_type", "text", "tool_name", "tool_call_id"]
    view = kept.select(*shape, F.col("ord").alias("_at"), F.lit(1).alias("_own"), F.lit(0).alias("_nth"), F.col("_touched").isNotNull().alias("_touched"))
    if inject:
        at = active.select("conv_id", "block_id", F.explode("effective_message_ids").alias("id")).join(messages.select("conv_id", "id", "ord"), ["conv_id", "id"])
        at = at.groupBy("conv_id", "block_id").agg(F.min("ord").alias("_raw"))
        own = messages.filter(rendered_summary()).select("conv_id", F.expr(f"substring(id, {len(SUMMARY_PREFIX) + 1})").alias("block_id"), F.col("ord").alias("_summary"))
        head = F.when(F.col("topic").isNull() | (F.col("topic") == ""), SUMMARY_HEADER).otherwise(F.concat(F.lit(f"{SUMMARY_HEADER} — "), "topic"))
        body = F.regexp_replace(F.coalesce("summary", F.lit("")), "(?U)^[\\s\\uFEFF]+|[\\s\\uFEFF]+$", "")
        none = F.lit(None).cast("string")
        lines = active.join(at, ["conv_id", "block_id"], "left").join(own, ["conv_id", "block_id"], "left")
        lines = lines.join(touched, "conv_id", "left_semi").select(
            "conv_id",
            F.concat(F.lit(SUMMARY_PREFIX), "block_id").alias("id"),
            F.lit("system").alias("role"),
            F.lit("text").alias("content_type"),
            F.when(body == "", head).otherwise(F.concat(head, F.lit("\n"), body)).alias("text"),
            none.alias("tool_name"),
            none.alias("tool_call_id"),
            F.coalesce("_summary", "_raw", F.lit(0)).alias("_at"),
            F.lit(0).alias("_own"),
            F.col("block_num").alias("_nth"),
            F.lit(True).alias("_touched"),
        )
        view = view.unionByName(lines)
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("_at", "_own", "_nth")) - 1
    view = view.withColumn("ord", order.cast("long")).drop("_at", "_own", "_nth")
    view = strip_orphans(view, F.col("_touched")) if strip else view
    return view.drop("_touched").select("conv_id", "ord", *shape[1:])


def strip_orphans(messages: DataFrame, where: Column | None = None) -> DataFrame:
    """Without calls that have no result (``compress`` stays), then results that have no call left,
    then reasoning that no assistant text or call follows.  ``where`` limits it to some rows'
    conversations.  Presence is a window over the call id, so a pair meets in one shuffle.
    """
    on = F.lit(True) if where is None else where
    pair = Window.partitionBy("conv_id", "tool_call_id")
    call, result = F.col("content_type") == "tool-call", F.col("content_type") == "tool-result"
    named = F.coalesce(F.col("tool_call_id") != "", F.lit(False))
    rows = messages.withColumn("_results", F.max(result.cast("int")).over(pair))
    lost = call & named & F.coalesce(F.col("tool_name") != "compress", F.lit(True)) & (F.col("_results") == 0)
    rows = rows.filter(~(on & lost)).withColumn("_calls", F.max(call.cast("int")).over(pair))
    rows = rows.filter(~(on & result & named & (F.col("_calls") == 0))).drop("_results", "_calls")
    other = F.when(F.col("content_type") != "reasoning", F.struct("role", "content_type"))
    after = Window.partitionBy("conv_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    follows = F.first(other, ignorenulls=True).over(after)
    fits = F.coalesce((follows["role"] == "assistant") & follows["content_type"].isin("text", "tool-call"), F.lit(False))
    return rows.withColumn("_fits", fits).filter(~(on & (F.col("content_type") == "reasoning") & ~F.col("_fits"))).drop("_fits")


def hide_compress_calls(messages: DataFrame, blocks: DataFrame, keep_orphans: int = 2) -> DataFrame:
    """Without ``compress`` calls that no active block stems from, except the newest ones that no block
    at all knows, and without the results of hidden calls.  (Texts are rewritten in ``plans.fold``.)"""
    calls = blocks.filter("compress_call_id is not null and compress_call_id <> ''").groupBy("conv_id", F.col("compress_call_id").alias("tool_call_id")).agg(F.max("active").alias("_live"))
    is_call = (F.col("tool_name") == "compress") & (F.col("content_type") == "tool-call")
    rows = messages.join(calls, ["conv_id", "tool_call_id"], "left").withColumn("_call", F.coalesce(is_call, F.lit(False)))
    named = F.coalesce(F.col("tool_call_id") != "", F.lit(False))
    orphan = F.col("_call") & named & F.col("_live").isNull()
    nth = F.sum(F.when(orphan, 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_newest", orphan & (nth <= keep_orphans))
    pair = Window.partitionBy("conv_id", "tool_call_id")
    rows = rows.withColumn("_kept", named & (F.coalesce("_live", F.lit(False)) | F.max("_newest").over(pair)))
    hidden = F.col("_call") & ~F.col("_kept")
    rows = rows.withColumn("_hidden", hidden).withColumn("_other", named & F.max(hidden).over(pair) & (F.col("content_type") == "tool-result"))
    return rows.filter("not _hidden and not _other").select(messages.columns)


def render_tags(messages: DataFrame, refs: DataFrame, snapshot: DataFrame | None = None, strategy: str = "all") -> DataFrame:
    """Texts behind a tag with reference, token count and kind; an own tag of before is replaced.
    Counts of ``snapshot(conv_id, ref, tokens)`` stay as first written."""
    if strategy == "none":
        return messages
    rows = messages.join(refs.select("conv_id", F.col("raw_id").alias("id"), "ref"), ["conv_id", "id"], "left")
    rows = rows.join(snapshot.select("conv_id", "ref", "tokens"), ["conv_id", "ref"], "left") if snapshot is not None else rows.withColumn("tokens", F.lit(None).cast("long"))
    # Fixed values of the message format: the tag.
    own = F.concat(F.lit('^<acp [^>]*>'), F.col("ref"), F.lit("</acp>\\n?"))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), own, F.lit(""))
    n = F.coalesce("tokens", count_tokens(clean))
    tag = F.concat(F.lit('<acp tokens="'), short_count(n), F.lit('" type="'), message_kind(), F.lit('">'), F.col("ref"), F.lit("</acp>\n"))
    tagged = F.col("ref").isNotNull() & (F.col("ref") != BLOCKED)
    if strategy == "text-only":
        tagged = tagged & (F.col("content_type") == "text")
    return rows.withColumn("text", F.when(tagged, F.concat(tag, clean)).otherwise(F.col("text"))).select(messages.columns)


def short_count(n: Column) -> Column:
    """123, 1.2K, 12K."""
    tenths = F.floor(n / 100 + 0.5)
    small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("K"))
    return F.when(n < 1000, n.cast("string")).when(n < 10_000, small).otherwise(F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("K")))


def keep_last(messages: DataFrame, matches: Column) -> DataFrame:
    """Of the texts that match, all but a conversation's last become empty; the rows stay."""
    hit = F.coalesce(matches & (F.col("text") != ""), F.lit(False))
    later = F.max(hit.cast("int")).over(Window.partitionBy("conv_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing))
    return messages.withColumn("text", F.when(hit & (F.coalesce(later, F.lit(0)) == 1), "").otherwise(F.col("text")))


def leading_system(messages: DataFrame) -> DataFrame:
    """(conv_id, system): the texts of the system rows that a conversation starts with, joined."""
    before = F.sum((F.col("role") != "system").cast("int")).over(Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    head = messages.withColumn("_n", before).filter("_n = 0")
    return head.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n").alias("system"))


def role_runs(messages: DataFrame) -> DataFrame:
    """(conv_id, run, role, first_ord, last_ord, parts): neighbours of one role together."""
    w = Window.partitionBy("conv_id").orderBy("ord")
    turn = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(0))
    rows = messages.withColumn("_new", turn).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("parts"))


def overlapping_blocks(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Active blocks that cover any of ``ids(conv_id, id)``."""
    own = blocks.filter("active").select("conv_id", "block_id", F.explode("effective_message_ids").alias("id"))
    return blocks.join(own.join(ids.select("conv_id", "id"), ["conv_id", "id"], "left_semi").select("conv_id", "block_id").distinct(), ["conv_id", "block_id"], "left_semi")


def lineage(blocks: DataFrame, depth: int = 64) -> DataFrame:
    """(conv_id, block_id, below, depth): blocks that each block consumed, directly or through others.

    Rounds of one join each, written as they come, so no round runs those before it again; a tier has at most
    two below it, so two or three rounds suffice, and ``depth`` only guards against circles in damaged state.
    """
    edges = blocks.select("conv_id", "block_id", F.explode("direct_block_ids").alias("below"))
    step = edges.select("conv_id", F.col("block_id").alias("below"), F.col("below").alias("_next"))
    found = level = edges.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        level = level.join(step, ["conv_id", "below"]).select("conv_id", "block_id", F.col("_next").alias("below"), F.lit(d).alias("depth"))
        level = written(level, "lineage")
        if level.isEmpty():
            break
        found = found.union(level)
    return found.groupBy("conv_id", "block_id", "below").agg(F.min("depth").alias("depth"))


def active_below(blocks: DataFrame) -> DataFrame:
    """(conv_id, block_id, owner): the nearest active block below each, the lowest number first."""
    state = blocks.filter("active").select("conv_id", F.col("block_id").alias("below"), "block_num")
    return lineage(blocks).join(state, ["conv_id", "below"]).groupBy("conv_id", "block_id").agg(F.min_by("below", F.struct("depth", "block_num")).alias("owner"))


def deactivate(blocks: DataFrame, targets: DataFrame, deep: bool = False) -> DataFrame:
    """Blocks with ``targets(conv_id, block_id)`` off, and with ``deep`` all below them."""
    off = targets.select("conv_id", "block_id")
    if deep:
        off = off.union(lineage(blocks).join(off, ["conv_id", "block_id"], "left_semi").select("conv_id", F.col("below").alias("block_id")))
    off = off.distinct().withColumn("_off", F.lit(True))
    return blocks.join(off, ["conv_id", "block_id"], "left").withColumn("active", F.col("active") & F.col("_off").isNull()).select(blocks.columns)


def block_content(messages: DataFrame, blocks: DataFrame, full: bool = False) -> DataFrame:
    """(conv_id, block_id, items, content): what a block stands for; active blocks inside it stay folded
    to their summaries, unless ``full``."""
    label = F.when(is_tool() & F.coalesce(F.col("tool_name") != "", F.lit(False)), F.concat(F.lit("["), "role", F.lit(" • "), "tool_name", F.lit("]\n"))).otherwise(F.concat(F.lit("["), "role", F.lit("]\n")))
    own = blocks.select("conv_id", "block_id", F.explode("effective_message_ids").alias("id")).distinct()
    inner = blocks.select("conv_id", "block_id", F.posexplode("direct_block_ids").alias("_pos", "_child"))
    child = blocks.filter("active").select("conv_id", F.col("block_id").alias("_child"), "topic", "summary", F.col("effective_message_ids").alias("_ids"))
    inner = inner.join(child, ["conv_id", "_child"])
    if not full:
        own = own.join(inner.select("conv_id", "block_id", F.explode("_ids").alias("id")).distinct(), ["conv_id", "block_id", "id"], "left_anti")
    said = own.join(messages, ["conv_id", "id"]).select("conv_id", "block_id", F.lit(1).alias("g"), F.col("ord").alias("n"), F.concat(label, F.coalesce("text", F.lit(""))).alias("t"))
    if not full:
        name = F.when(F.coalesce(F.col("topic"), F.lit("")) == "", F.col("_child")).otherwise(F.concat("_child", F.lit(": "), "topic"))
        said = said.unionByName(inner.select("conv_id", "block_id", F.lit(0).alias("g"), F.col("_pos").cast("long").alias("n"), F.concat(F.lit(f"{SUMMARY_HEADER} — "), name, F.lit("\n"), "summary").alias("t")))
    parts = F.sort_array(F.collect_list(F.struct("g", "n", "t")))
    return said.groupBy("conv_id", "block_id").agg(F.count("*").alias("items"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("content"))


def restored_preview(messages: DataFrame, before: DataFrame, after: DataFrame, most: int = 2000, each: int = 200) -> DataFrame:
    """(conv_id, restored, preview): messages that ``before`` covered and ``after`` doesn't, the first
    ones as cut lines until ``most`` characters are passed."""
    back = messages.join(covered(before), ["conv_id", "id"], "left_semi").join(covered(after), ["conv_id", "id"], "left_anti")
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > each, F.concat(F.substring(text, 1, each), F.lit("..."))).otherwise(text)
    tool = F.coalesce((F.col("tool_name") != "") & (F.col("content_type") != "text"), F.lit(False))
    line = F.when(tool, F.concat("tool_name", F.lit(": "), cut)).otherwise(F.concat(F.lit("["), "role", F.lit("] "), cut))
    rows = back.withColumn("_line", line)
    so_far = F.coalesce(F.sum(F.length("_line") + 1).over(Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_shown", so_far < most)
    lines = F.sort_array(F.collect_list(F.when(F.col("_shown"), F.struct("ord", "_line"))))
    return rows.groupBy("conv_id").agg(F.count("*").alias("restored"), F.array_join(F.transform(lines, lambda s: s["_line"]), "\n").alias("preview"))
