"""Aggregates behind the status reports, the nudge decision, and their texts."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.functions.scalars import SUMMARY_HEADER, clamp_growth, count_tokens, is_tool

from .coverage import visible


def context_breakdown(messages: DataFrame) -> DataFrame:
    """(conv_id, system, tool, summaries, code, text, total): tokens by sort, the first that fits."""
    sort = (
        F.when(F.coalesce(F.col("text").startswith(SUMMARY_HEADER), F.lit(False)), "summaries")
        .when(is_tool(), "tool")
        .when(F.col("role") == "system", "system")
        .when(F.coalesce(F.col("text").contains("```"), F.lit(False)), "code")
        .otherwise("text")
    )
    rows = messages.select("conv_id", sort.alias("sort"), count_tokens("text").alias("n"))
    names = ("system", "tool", "summaries", "code", "text")
    return rows.groupBy("conv_id").agg(*[F.sum(F.when(F.col("sort") == s, F.col("n")).otherwise(0)).alias(s) for s in names], F.sum("n").alias("total"))


def visible_messages(messages: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, ord, ref, tokens, tool) of messages that are neither covered nor nameless nor empty."""
    rows = visible(messages, blocks).join(refs.select("conv_id", F.col("raw_id").alias("id"), "ref"), ["conv_id", "id"])
    rows = rows.select("conv_id", "ord", "ref", count_tokens("text").alias("tokens"), F.coalesce("tool_name", F.lit("text")).alias("tool"))
    return rows.filter((F.col("tokens") > 0) & (F.col("ref") != ""))


def top_tools(shown: DataFrame, k: int = 3) -> DataFrame:
    per = shown.groupBy("conv_id", "tool").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("messages"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("tokens"), "tool"))
    return per.withColumn("nth", nth).filter(F.col("nth") <= k)


def message_listing(shown: DataFrame, sort: str = "size", limit: int = 30, tool: str | None = None) -> DataFrame:
    orders = {"time": ["ord"], "tool": ["tool", F.desc("tokens"), "ord"]}
    rows = shown if tool is None else shown.filter(F.col("tool") == tool)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*orders.get(sort, [F.desc("tokens"), "ord"])))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= limit)


def block_listing(blocks: DataFrame, sort: str = "size", limit: int = 30) -> DataFrame:
    orders = {"time": ["created_at"], "age": [F.desc("survived_count")]}
    by = orders.get(sort, [F.desc("compressed_tokens"), *([F.desc("created_at")] if "created_at" in blocks.columns else [])])
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*by, "block_num"))
    return blocks.filter("active").withColumn("summary_tokens", count_tokens("summary")).withColumn("nth", nth).filter(F.col("nth") <= limit)


def tier_usage(blocks: DataFrame) -> DataFrame:
    """(conv_id, tier, blocks, tokens) of active blocks, where a conversation has two tiers or more."""
    per = blocks.filter("active").groupBy("conv_id", "tier").agg(F.count("*").alias("blocks"), F.sum(count_tokens("summary")).alias("tokens"))
    return per.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id"))).filter("_n >= 2").drop("_n")


def status(blocks: DataFrame, totals: DataFrame, config: Config) -> DataFrame:
    """(conv_id, token_count, context_usage, active_blocks, total_blocks, tokens_compressed)."""
    per = blocks.groupBy("conv_id").agg(F.count_if("active").alias("active_blocks"), F.count("*").alias("total_blocks"), F.sum("compressed_tokens").alias("tokens_compressed"))
    out = totals.join(per, "conv_id", "left").na.fill(0, ["active_blocks", "total_blocks", "tokens_compressed"])
    limit = config.model_context_limit
    return out.withColumn("context_usage", F.col("token_count") / limit if limit > 0 else F.lit(0.0))


def pending_by_tier(merged: DataFrame, blocks: DataFrame, least_chars: int) -> DataFrame:
    """(conv_id, t1, t2, t3): tokens that each tier could give back."""
    rows = merged.filter(F.coalesce("chars", F.col("tokens") * 4) >= least_chars) if least_chars > 0 else merged
    one = rows.groupBy("conv_id").agg(F.sum("tokens").alias("t1"))
    n = count_tokens("summary")
    rest = blocks.filter("active").groupBy("conv_id").agg(F.sum(F.when(F.col("tier") == 1, n).otherwise(0)).alias("t2"), F.sum(F.when(F.col("tier") == 2, n).otherwise(0)).alias("t3"))
    return one.join(rest, "conv_id", "full").na.fill(0)


def decide_nudge(turns: DataFrame, config: Config) -> DataFrame:
    """``turns(conv_id, token_count, t1, t2, t3, baseline, last_shown, shown2, shown3)`` with usage, growth,
    ``tier`` (null: no nudge) and ``pressure``.

    Under pressure the tier with most to give wins, the lower on ties.  Else growth must reach its
    floor, and tier 1 goes before 2 before 3; a tier that would come but was shown too lately
    blocks those behind it.
    """
    n, limit = config.nudge, config.model_context_limit
    count = F.col("token_count")
    grow = clamp_growth(F.lit(float(limit)), n.growth_ratio, n.growth_floor, n.growth_cap)
    floor = F.greatest(F.lit(float(n.min_growth_floor)), grow * n.min_growth_ratio)
    usage = count / limit if limit > 0 else F.lit(0.0)
    since = F.when(F.col("last_shown") > 0, F.col("last_shown")).when(F.col("baseline") > 0, F.col("baseline")).otherwise(count)
    rows = turns.withColumns({"usage": usage, "growth": count - since, "_grow": grow, "_floor": floor})
    pressure = (F.col("usage") >= n.max_context_limit_pct) | (F.col("usage") >= n.emergency_threshold_pct)
    t1, t2, t3 = (F.col(f"t{i}") for i in (1, 2, 3))
    most = F.greatest(t1, t2, t3) if config.tiers.enabled else t1
    forced = F.when(most <= 0, F.lit(None)).when(t1 == most, 1).when(t2 == most, 2).otherwise(3)
    many = F.floor(F.col("_grow") * n.tier2_growth_multiplier + 0.5)
    free = lambda c: (F.col(c) == 0) | (count - F.col(c) >= F.col("_floor"))
    two = F.lit(config.tiers.enabled) & (t2 >= many) & (t2 > t1)
    three = F.lit(config.tiers.enabled) & (t3 >= many) & (t3 > t2) & (t3 > t1)
    grown = F.when(t1 >= F.col("_grow"), 1).when(two, F.when(free("shown2"), 2)).when(three, F.when(free("shown3"), 3))
    tier = F.when(pressure, forced).when(F.col("growth") >= F.col("_floor"), grown)
    return rows.withColumns({"pressure": pressure, "tier": tier.cast("int")}).drop("_grow", "_floor")


def explain_nudge(turns: DataFrame, config: Config) -> DataFrame:
    """:func:`decide_nudge` with what it weighed: reference, step, floor, over_limit, emergency, and ``reason``, which
    names the tier and what it gives, or every condition that isn't met."""
    n = config.nudge
    rows = decide_nudge(turns, config)
    step = clamp_growth(F.lit(float(config.model_context_limit)), n.growth_ratio, n.growth_floor, n.growth_cap).cast("long")
    floor = F.greatest(F.lit(float(n.min_growth_floor)), step * n.min_growth_ratio)
    tiers = ("t1", "t2", "t3") if config.tiers.enabled else ("t1",)
    most = F.greatest(*tiers) if len(tiers) > 1 else F.col("t1")
    limit = config.model_context_limit
    share = F.concat(F.floor(F.col("token_count") * 100 / limit + 0.5 if limit > 0 else F.lit(0)).cast("string"), F.lit("%"))
    given = F.when(F.col("tier") == 1, F.col("t1")).when(F.col("tier") == 2, F.col("t2")).otherwise(F.col("t3"))
    lately = [F.when((F.col(f"t{k}") >= step) & (F.col(f"shown{k}") > 0) & (F.col("token_count") - F.col(f"shown{k}") < floor), F.lit(f"tier {k} was shown lately")) for k in (2, 3) if config.tiers.enabled]
    short = F.concat_ws("; ", F.when(most < step, F.concat(F.lit("most to gain "), most, F.lit(" below "), step)), F.when(F.col("growth") < floor, F.concat(F.lit("growth "), F.col("growth"), F.lit(" below "), floor.cast("long"))), *lately)
    named = F.concat(F.lit("tier "), F.col("tier"), F.lit(": "))
    reason = (
        F.when(F.col("tier").isNotNull() & F.col("pressure"), F.concat(named, F.lit("usage "), share))
        .when(F.col("tier").isNotNull(), F.concat(named, given, F.lit(" tokens to gain")))
        .when(F.col("pressure"), F.concat(F.lit("nothing to gain at usage "), share))
        .when(short == "", F.lit("no tier stands out"))
        .otherwise(short)
    )
    return rows.withColumns({"reference": F.col("token_count") - F.col("growth"), "step": step, "floor": floor, "over_limit": F.col("usage") >= n.max_context_limit_pct, "emergency": F.col("usage") >= n.emergency_threshold_pct, "reason": reason})


def recap_text(blocks: DataFrame, block_id: str | None = None) -> DataFrame:
    """(conv_id, text): the heads of a conversation's active blocks, or one block in full."""
    topic = F.coalesce("topic", F.lit("(none)"))
    size = F.concat(F.size("effective_message_ids").cast("string"), F.lit(" messages"))
    if block_id is None:
        head = F.concat(F.substring("summary", 1, 200), F.when(F.length("summary") > 200, "...").otherwise(""))
        lines = F.concat(F.lit("\n"), F.col("block_id"), F.lit(" | "), size, F.lit(' | "'), topic, F.lit('"\n  '), head)
        per = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("active"), F.struct("block_num", lines.alias("line"))))).alias("b"))
        many = F.concat(F.lit("Active compression blocks ("), F.size("b").cast("string"), F.lit("):\n"), F.array_join(F.col("b.line"), "\n"), F.lit("\n\nName a block to get its full summary."))
        return per.select("conv_id", F.when(F.size("b") == 0, F.lit("No active compression blocks.")).otherwise(many).alias("text"))
    live = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("active"), F.struct("block_num", "block_id")))), lambda b: b["block_id"]), ", ")
    whole = F.concat(F.lit(f"{SUMMARY_HEADER}\n"), F.col("summary"), F.lit(f"\n\n[{block_id} | "), size, F.lit(' | topic: "'), topic, F.lit('"]'))
    own = F.when(F.col("active"), whole).otherwise(F.lit(f"Block {block_id} is inactive: another block holds its content."))
    return blocks.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("block_id") == block_id, own)), F.concat(F.lit(f"Block {block_id} not found. Active blocks: "), live)).alias("text"))


def recap(blocks: DataFrame) -> DataFrame:
    return blocks.filter("active").select("conv_id", "block_id", "block_num", "tier", F.substring("summary", 1, 200).alias("head"))


# Texts, in the driver.


def fixed1(x: float) -> str:
    """One decimal, ties of the exact binary value upwards."""
    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def format_tokens(n: float) -> str:
    return "0" if not n or n <= 0 else f"{fixed1(n / 1000)}K" if n >= 1000 else f"{n:g}"


def format_short(n: int) -> str:
    """123, 1.2K, 12K; tenths are rounded as whole numbers, as ``coverage.short_count`` does."""
    tenths = int(n + 50) // 100
    return str(n) if n < 1000 else f"{tenths // 10}.{tenths % 10}K" if n < 10_000 else f"{int(n / 1000 + 0.5)}K"


def percent(n: float, total: float) -> int:
    return 0 if n <= 0 or total <= 0 else max(1, int(n * 100 / total + 0.5))


def bar(value: float, total: float, width: int = 20) -> str:
    full = 0 if total <= 0 else min(width, max(0, int(value / total * width + 0.5)))
    return "█" * full + "░" * (width - full)


def status_text(shown: list, blocks: list, limit: int = 30) -> str:
    """An overview of one conversation from rows of ``visible_messages`` and ``block_listing``."""
    by: dict[str, int] = {}
    for r in shown:
        by[r["tool"]] = by.get(r["tool"], 0) + r["tokens"]
    text, summaries = by.get("text", 0), sum(b["summary_tokens"] for b in blocks)
    tool = sum(by.values()) - text
    total = tool + text + summaries
    part = lambda n, name: f"{format_tokens(n)} {name} ({percent(n, total)}%)"
    lines = ["Context", "  " + " | ".join([part(tool, "tool"), part(text, "text"), part(summaries, "summaries")])]
    top = sorted(by.items(), key=lambda x: -x[1])[:3]
    lines += ["  Largest: " + ", ".join(f"{t} ({percent(n, total)}%)" for t, n in top)] if top else []
    lines += ["", f"Blocks: {len(blocks)} active"]
    lines += [f"  {b['block_id']} (T{b['tier']})  {format_tokens(b['compressed_tokens'])} to {format_tokens(b['summary_tokens'])}  {b['topic'] or '(no topic)'}" for b in blocks[:limit]]
    return "\n".join(lines)


def panel_text(title: str, used: int, limit: int, parts: dict[str, int], blocks: list) -> str:
    """Bars of usage and of each sort of content, then the blocks."""
    lines = [f"{title}  {format_tokens(used)} of {format_tokens(limit)}  {bar(used, limit)} {percent(used, limit)}%"]
    lines += [f"  {name:<10} {bar(n, max(1, sum(parts.values())))} {format_tokens(n)}" for name, n in parts.items() if n > 0]
    return "\n".join(lines + [f"  {b['block_id']} T{b['tier']} {b['topic'] or '-'}" for b in blocks])


#: Instructions that go with a nudge; replace them by ``prompts``.
PROMPTS = {
    "aim": "Fold finished parts of the conversation into summaries to free room.",
    "how": "Pick closed ranges, keep decisions, paths, errors and open points, and write one summary for each.",
    2: "Distil the listed first-tier blocks into one block that keeps their facts.",
    3: "Condense the listed second-tier blocks to what later work still needs.",
    "urgent": "The window is nearly full: compress now, before anything else.",
}


def resolve_prompts(overrides: dict | None = None, acknowledge_risk: bool = False) -> dict:
    """The prompts with replacements; whoever replaces any must say so knowingly."""
    if overrides and not acknowledge_risk:
        raise ValueError("prompt overrides need acknowledge_risk=True")
    return PROMPTS | {k: v for k, v in (overrides or {}).items() if v}


def nudge_text(decision, ranges: list, blocks: list, prompts: dict = PROMPTS) -> tuple[str, str]:
    """(voice, text) for a decided nudge."""
    voice = "emergency" if decision["pressure"] else "gentle" if decision["tier"] == 1 else f"tier{decision['tier']}"
    lines = [prompts["urgent"]] if decision["pressure"] else [prompts["aim"]]
    if decision["tier"] == 1:
        lines += [prompts["how"], *[f"  {r['start_ref']}..{r['end_ref']}  {r['count']} messages, {format_short(r['tokens'])} tokens, {r['tool_pct']}% tool" for r in ranges]]
    else:
        lines += [prompts[decision["tier"]], *[f"  {b['block_id']}: {b['topic'] or b['summary'][:60]}" for b in blocks]]
    return voice, "\n".join([*lines, f"Usage {int(decision['usage'] * 100 + 0.5)}%."])


def transform_channel(explicit: Column, wire_viable: Column) -> Column:
    return F.coalesce(explicit, F.when(wire_viable, "wire").otherwise("message"))
