"""Status reports as texts, one a conversation.

Rows are chosen, sorted and limited by the set operators of ``reports``; Python only writes the lines.
Layouts are fixed values of the reports: they are what a model or a person reads.
"""

from __future__ import annotations

from collections import namedtuple
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import count_tokens
from threadloom.sources.grouped import by_key

from .ranges import islands
from .reports import format_tokens, percent, visible_messages

SCOPES = ("overview", "compressed", "messages", "ranges")
#: Ranges that a report lists at most.
MOST_RANGES = 30


Shown = namedtuple("Shown", "ref tokens tool run")
Held = namedtuple("Held", "block_id tier topic compressed_tokens summary_tokens messages survived_count generation children")


def _sum(rows: list, name: str) -> int:
    return sum(getattr(r, name) for r in rows)


def _tiers(blocks: list[Held]) -> str | None:
    """Summary tokens by tier, if there is more than one."""
    per: dict[int, int] = {}
    for b in blocks:
        per[b.tier] = per.get(b.tier, 0) + b.summary_tokens
    return " | ".join(f"T{t}: {format_tokens(n)}" for t, n in sorted(per.items()) if n) if len(per) > 1 else None


def _name(topic) -> str:
    return topic if isinstance(topic, str) else "(no topic)"


def _overview(shown: list[Shown], blocks: list[Held], sort: str, limit: int, tool: str | None) -> list[str]:
    per: dict[str, int] = {}
    for m in shown:
        per[m.tool] = per.get(m.tool, 0) + m.tokens
    text, summaries = per.get("text", 0), _sum(blocks, "summary_tokens")
    tools = sum(per.values()) - text
    total = tools + text + summaries
    top = sorted(per, key=lambda t: -per[t])
    part = lambda n, name: f"{format_tokens(n)} {name} ({percent(n, total)}%)"
    out = ["CONTEXT BREAKDOWN", "  " + " | ".join([part(tools, "tool"), part(text, "text"), part(summaries, "summaries")])]
    if top:
        out.append("  Top tools: " + ", ".join(f"{t} ({percent(per[t], total)}%)" for t in top[:3]))
    out.append("")
    if not blocks:
        out += ["COMPRESSED BLOCKS", "  No compressed blocks."]
    else:
        out.append(f"COMPRESSED BLOCKS — {len(blocks)} active ({format_tokens(summaries)} summary, {format_tokens(_sum(blocks, 'compressed_tokens'))} original)")
        out += [f"  Tier usage: {tiers}"] if (tiers := _tiers(blocks)) else []
        out.append("")
        out += [f"  {b.block_id} (T{b.tier})  {format_tokens(b.compressed_tokens)}→{format_tokens(b.summary_tokens)}  {b.messages} msgs  \"{_name(b.topic)}\"" for b in blocks[:limit]]
    return [*out, "", f'Tip: status_report(scope="messages", tool="{top[0] if top else "bash"}") lists the messages']


def _compressed(shown: list[Shown], blocks: list[Held], sort: str, limit: int, tool: str | None) -> list[str]:
    out = [f"COMPRESSED — {len(blocks)} blocks | {format_tokens(_sum(blocks, 'compressed_tokens'))} original → {format_tokens(_sum(blocks, 'summary_tokens'))} summary"]
    out += [f"Tier usage: {tiers}"] if (tiers := _tiers(blocks)) else []
    out.append("")
    for b in blocks[:limit]:
        inside = f" nested=[{','.join(b.children)}]" if b.children else ""
        out += [f"  {b.block_id} (T{b.tier})  {format_tokens(b.compressed_tokens)}→{format_tokens(b.summary_tokens)}  {b.messages} msgs  age={b.survived_count} {b.generation}{inside}", f'    "{_name(b.topic)}"']
    return out + ["", f"{limit} of {len(blocks)} shown."] * (len(blocks) > limit)


def _messages(shown: list[Shown], blocks: list[Held], sort: str, limit: int, tool: str | None) -> list[str]:
    some = shown if tool is None else [m for m in shown if m.tool == tool]
    n, every = _sum(some, "tokens"), _sum(shown, "tokens")
    head = f"UNCOMPRESSED — {format_tokens(n)} | {len(some)} msgs" if tool is None else f"UNCOMPRESSED — {tool}: {format_tokens(n)} | {len(some)} msgs | {percent(n, every)}% of visible"
    out = [head, f"Sorted by {sort}", "", *[f"  {m.ref} ({format_tokens(m.tokens)}) {m.tool}" for m in some[:limit]]]
    return out + ["", f"{limit} of {len(some)} shown."] * (len(some) > limit)


def _ranges(shown: list[Shown], blocks: list[Held], sort: str, limit: int, tool: str | None) -> list[str]:
    out = [f"UNCOMPRESSED — {format_tokens(_sum(shown, 'tokens'))} | {len(shown)} visible messages", ""]
    if not shown:
        return [*out, "  (no uncompressed messages)"]
    runs = [list(g) for _, g in groupby(shown, lambda m: m.run)]
    for g in runs[:MOST_RANGES]:
        n, tokens = len(g), _sum(g, "tokens")
        name = g[0].ref if n == 1 else f"{g[0].ref}–{g[-1].ref}"
        each = f" ({int(tokens / n + 0.5)}/msg)" if n > 1 else ""
        out.append(f"  {name}  ({n} msgs, {format_tokens(tokens)}{each}) {g[0].tool}")
    return out + [f"  ... and {len(runs) - MOST_RANGES} more ranges"] * (len(runs) > MOST_RANGES)


_WRITE = {"overview": _overview, "compressed": _compressed, "messages": _messages, "ranges": _ranges}


def status_report(messages: DataFrame, refs: DataFrame, blocks: DataFrame, scope: str = "overview", sort: str = "size", limit: int = 30, tool: str | None = None) -> DataFrame:
    """(conv_id, text) of every conversation in ``messages``.

    ``scope`` is one of ``SCOPES``; ``sort`` orders messages (size, time, tool) or blocks (size, time, age);
    ``tool`` keeps messages of one tool.  ``blocks`` may lack created_at, survived_count and generation.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    key = messages.schema["conv_id"].dataType.simpleString()
    by = {"time": ["ord"], "tool": ["tool", F.desc("tokens"), "ord"]}.get(sort, [F.desc("tokens"), "ord"]) if scope == "messages" else ["ord"]
    shown = islands(visible_messages(messages, refs, blocks).withColumn("num", F.substring("ref", 2, 9).cast("int")))
    shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*by))).select("conv_id", "nth", "ref", "tokens", "tool", "_g")
    given = {"created_at": F.lit(0), "survived_count": F.lit(0), "generation": F.lit("young")}
    rows = blocks.filter("active").withColumns({c: v for c, v in given.items() if c not in blocks.columns})
    order = {"time": ["created_at"], "age": [F.desc("survived_count")]}.get(sort, [F.desc("compressed_tokens"), F.desc("created_at")]) if scope == "compressed" else [F.desc("compressed_tokens"), F.desc("created_at")]
    rows = rows.withColumns({"summary_tokens": count_tokens("summary"), "messages": F.size("effective_message_ids"), "nth": F.row_number().over(Window.partitionBy("conv_id").orderBy(*order, "block_num"))})
    # One table of three kinds of rows: conversations, so that those without visible messages have a report, too; messages; blocks.
    message, block = F.struct("ref", "tokens", "tool", "_g").alias("m"), F.struct("block_id", "tier", "topic", "compressed_tokens", "summary_tokens", "messages", "survived_count", "generation", F.col("direct_block_ids").alias("children")).alias("b")
    shown, rows = shown.select("conv_id", F.lit(1).alias("_kind"), "nth", message), rows.select("conv_id", F.lit(2).alias("_kind"), "nth", block)
    no = lambda of, name: F.lit(None).cast(of.schema[name].dataType).alias(name)
    every = messages.select("conv_id").distinct().select("conv_id", F.lit(0).alias("_kind"), F.lit(0).alias("nth"), no(shown, "m"), no(rows, "b"))
    every = every.unionByName(shown.select("*", no(rows, "b"))).unionByName(rows.select("conv_id", "_kind", "nth", no(shown, "m"), "b"))

    def run(at, group: list[tuple]) -> list[tuple]:
        if group[0][1] != 0:
            return []
        own, held = [Shown(*r[3].values()) for r in group if r[1] == 1], [Held(*r[4].values()) for r in group if r[1] == 2]
        return [(at, "\n".join(_WRITE[scope](own, held, sort, limit, tool)))]

    return by_key(every, "conv_id", ["_kind", "nth"], run, f"conv_id {key}, text string")
