"""One turn of a conversation: a list of nodes over messages, state and effects."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from threadloom.config import Config, validate

from .fold import assign_refs
from .protection import batches, recent_zone, split_ranges
from .state import BLOCKED, HEADER, PREFIX, Message, State, count_tokens, half_up, units

log = logging.getLogger(__name__)

# Fixed values of the message format: the truncation mark below, and the tag that ``render_node`` writes.
#: What counts as blank at a text's ends.
BLANKS = "\t\n\v\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
MARK = "[truncated for context space]"


@dataclass
class Turn:
    messages: list[Message]
    state: State
    config: Config
    token_count: int
    count: Callable[[str], int] = count_tokens
    effects: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Node:
    name: str
    run: Callable[[Turn], None]
    enabled: Callable[[Turn], bool] = lambda t: True


def refs_node(t: Turn) -> None:
    t.state.refs = assign_refs(t.messages, t.state, t.config)


def sync_node(t: Turn) -> None:
    s, here = t.state, {m.id for m in t.messages}
    live = {s.refs[i] for i in here if i in s.refs}
    s.snapshot = {r: n for r, n in s.snapshot.items() if r in live}
    held = {k for b in s.blocks for k in b.children}
    lost = []
    for b in s.blocks:
        shown = PREFIX + b.block_id in here or not here.isdisjoint(b.covers)
        b.active = shown and b.block_id not in held
        lost += [b.block_id] if not shown and b.block_id not in held else []
        b.survived += b.active
        if b.active and b.survived >= t.config.promotion_threshold:
            b.generation = "old"
    t.effects["deactivated"] = lost


def summary_of(block) -> Message:
    head = f"{HEADER} — {block.topic}" if block.topic else HEADER
    body = block.summary.strip(BLANKS)
    return Message(PREFIX + block.block_id, "system", "text", f"{head}\n{body}" if body else head)


def prune(messages: list[Message], s: State, inject: bool = True) -> list[Message]:
    covered = s.covered()
    if not covered:
        return list(messages)
    at = {m.id: i for i, m in enumerate(messages)}
    standing = {m.id: i for i, m in enumerate(messages) if m.is_summary}
    places = []
    for b in s.live if inject else []:
        own = standing.get(PREFIX + b.block_id)
        places.append((min((at[i] for i in b.covers if i in at), default=0) if own is None else own, summary_of(b)))
    stale = {m.id for _, m in places}
    first = next((i for i, m in enumerate(messages) if m.role == "user"), -1)
    rows = [(i, 1, 0, m) for i, m in enumerate(messages) if i == first or (m.id not in covered and not (m.is_summary and m.id in stale))]
    rows += [(i, 0, n, m) for n, (i, m) in enumerate(sorted(places, key=lambda p: p[0]))]
    return strip_orphans([m for *_, m in sorted(rows, key=lambda r: r[:3])])


def strip_orphans(messages: list[Message]) -> list[Message]:
    results = {m.tool_call_id for m in messages if m.content_type == "tool-result" and m.tool_call_id}
    kept = [m for m in messages if not (m.content_type == "tool-call" and m.tool_call_id and m.tool_name != "compress" and m.tool_call_id not in results)]
    calls = {m.tool_call_id for m in kept if m.content_type == "tool-call" and m.tool_call_id}
    kept = [m for m in kept if not (m.content_type == "tool-result" and m.tool_call_id and m.tool_call_id not in calls)]
    out, answered = [], False
    for m in reversed(kept):  # from behind: what the next message that isn't reasoning is
        if m.content_type != "reasoning":
            answered = m.answers
        if m.content_type != "reasoning" or answered:
            out.append(m)
    return out[::-1]


def prune_node(t: Turn) -> None:
    t.messages = prune(t.messages, t.state)


# Text filters: ``fn(text, role, index, total, tool_name)`` gives None to keep, "" to drop, or a new text.


@dataclass(frozen=True)
class TextFilter:
    name: str
    fn: Callable[..., str | None]
    version: str = "1"
    keep_last_only: bool = False


_filters: dict[str, TextFilter] = {}


def register_filter(f: TextFilter) -> None:
    known = _filters.get(f.name)
    if known and known.version != f.version:
        raise ValueError(f"filter {f.name} is registered in version {known.version}")
    _filters[f.name] = f


def filters() -> list[TextFilter]:
    return list(_filters.values())


def clear_filters() -> None:
    _filters.clear()


def _try(f: TextFilter, m: Message, text: str, i: int, total: int) -> str | None:
    try:
        return f.fn(text, m.role, i, total, m.tool_name)
    except Exception:  # a filter that fails leaves the text alone
        return None


def filter_node(t: Turn) -> None:
    on = [f for f in filters() if f.name not in t.config.filters_off]
    rows, total = list(t.messages), len(t.messages)
    for i, m in enumerate(rows):
        text = m.body
        for f in (f for f in on if not f.keep_last_only):
            new = _try(f, m, text, i, total) if m.body else None
            text = text if new is None else new
        rows[i] = m if text == m.body else replace(m, text=text)
    for f in (f for f in on if f.keep_last_only):
        seen = False
        for i in range(total - 1, -1, -1):
            m = rows[i]
            new = _try(f, m, m.body, i, total) if m.body else None
            if new is not None:
                if seen or new:
                    rows[i] = replace(m, text="" if seen else new)
                seen = True
    t.messages = rows


def hide_calls(messages: list[Message], s: State, keep: int = 2) -> list[Message]:
    """Without calls that left no active block; kept calls name only ranges that are still live."""
    known = {b.call_id for b in s.blocks if b.call_id}
    live: dict[str, set | None] = {}
    for b in s.live:
        if b.call_id:
            whole = b.start_ref is None or b.end_ref is None or live.get(b.call_id, set()) is None
            live[b.call_id] = None if whole else live.get(b.call_id, set()) | {(b.start_ref, b.end_ref)}
    is_call = lambda m: m.tool_name == "compress" and m.content_type == "tool-call"
    orphans = [m.tool_call_id for m in messages if is_call(m) and m.tool_call_id and m.tool_call_id not in known]
    kept = set(live) | set(orphans[len(orphans) - keep :] if len(orphans) > keep else orphans)
    hidden = {m.tool_call_id for m in messages if is_call(m) and m.tool_call_id not in kept}
    out = []
    for m in messages:
        if (is_call(m) and m.tool_call_id not in kept) or (m.content_type == "tool-result" and m.tool_call_id and m.tool_call_id in hidden):
            continue
        ranges = live.get(m.tool_call_id) if is_call(m) else None
        text = live_ranges_only(m.text, ranges) if ranges else None
        out.append(m if text is None else replace(m, text=text))
    return out


def live_ranges_only(text: str | None, live: set[tuple[str, str]]) -> str | None:
    """The call's JSON without entries that aren't live; None where nothing is to change."""
    try:
        whole = json.loads(text or "")
        entries = whole["content"]
    except (ValueError, TypeError, KeyError):
        return None
    if not isinstance(entries, list):
        return None
    end = lambda e, k: next((e[x] for x in (k, "messageId") if isinstance(e.get(x), str)), "")
    kept = [e for e in entries if isinstance(e, dict) and (end(e, "startId"), end(e, "endId")) in live]
    if not kept or len(kept) == len(entries):
        return None
    return json.dumps(whole | {"content": kept}, ensure_ascii=False, separators=(",", ":"))


def hide_node(t: Turn) -> None:
    t.messages = hide_calls(t.messages, t.state)


def recommend_node(t: Turn) -> None:
    zone = recent_zone(t.messages, t.state, t.config, t.count)
    free, held = split_ranges(t.messages, t.state, t.config, zone, t.count)
    t.effects |= {"ranges": free, "protected": held, "recommended": batches(free, t.config.compress.min_compress_range)}


def growth_step(c: Config) -> int:
    n, limit = c.nudge, c.model_context_limit
    return n.growth_floor if limit <= 0 else min(n.growth_cap, max(n.growth_floor, half_up(limit * n.growth_ratio)))


def decide(t: Turn) -> dict:
    """Which tier to ask for, if any."""
    s, c, n = t.state, t.config, t.config.nudge
    usage = t.token_count / c.model_context_limit if c.model_context_limit > 0 else 0.0
    step = growth_step(c)
    floor = max(n.min_growth_floor, n.min_growth_ratio * step)
    growth = t.token_count - (s.last_shown or s.baseline or t.token_count)
    least = c.compress.min_compress_range
    give = {1: sum(r.tokens for r in t.effects.get("recommended", []) if least <= 0 or r.size >= least)}
    give |= {k + 1: sum(t.count(b.summary) for b in s.live if b.tier == k) for k in (1, 2)}
    tiers = (1, 2, 3) if c.tiers.enabled else (1,)
    urgent = usage >= min(n.max_context_limit_pct, n.emergency_threshold_pct)
    tier = None
    if urgent:
        best = max(tiers, key=lambda k: (give[k], -k))
        tier = best if give[best] > 0 else None
    elif growth >= floor:
        many = half_up(step * n.tier2_growth_multiplier)
        ready = [k for k in tiers if (k == 1 and give[1] >= step) or (k > 1 and give[k] >= many and all(give[k] > give[j] for j in range(1, k)))]
        if ready:  # one that was shown too lately blocks those behind it
            last = s.shown.get(ready[0], 0)
            tier = ready[0] if ready[0] == 1 or last == 0 or t.token_count - last >= floor else None
    return {"tier": tier, "usage": usage, "growth": growth, "pressure": urgent, "pending": give, "step": step, "floor": floor, "targets": [b.block_id for b in s.live if tier in (2, 3) and b.tier == tier - 1]}


def nudge_node(t: Turn) -> None:
    d, s = decide(t), t.state
    if s.baseline > 0 and t.token_count < s.baseline - d["step"]:
        s.baseline, s.last_shown, s.shown = t.token_count, 0, {}
    s.baseline = s.baseline or t.token_count
    if d["tier"]:
        s.last_shown = t.token_count
        s.shown = s.shown | {d["tier"]: t.token_count}
    t.effects["nudge"] = d


def truncate(messages: list[Message], token_count: int, c: Config, count=count_tokens, least: int = 1000, prefix: int = 2000, suffix: int = 2000, recent: int = 3) -> tuple[list[Message], int, int]:
    """(messages, cut, saved): the largest tool results lose their middle until nine tenths of the threshold are met."""
    limit = c.truncate_threshold * c.model_context_limit
    if c.model_context_limit <= 0 or token_count < limit:
        return messages, 0, 0
    rows, saved, cut = list(messages), 0, 0
    sized = [(count(m.body), i) for i, m in enumerate(messages[: max(0, len(messages) - recent)]) if m.content_type == "tool-result" and m.body and MARK not in m.body]
    for n, i in sorted((x for x in sized if x[0] >= least), key=lambda x: -x[0]):
        if token_count - saved <= limit * 0.9:
            break
        text = messages[i].body
        if units(text) > prefix + suffix:
            new = f"{text[:prefix]}\n\n...{MARK} — original ~{n} tokens]...\n\n{text[-suffix:] if suffix else text}"
            rows[i], saved, cut = replace(messages[i], text=new), saved + n - count(new), cut + 1
    return (rows if cut else messages), cut, saved


def truncate_node(t: Turn) -> None:
    t.messages, t.effects["truncated"], _ = truncate(t.messages, t.token_count, t.config, t.count, recent=t.config.preserve_recent_messages)


def render_node(strategy: str = "all") -> Node:
    def run(t: Turn) -> None:
        from threadloom.operators.reports import format_short

        rows = []
        for m in t.messages:
            ref = t.state.refs.get(m.id)
            if ref and ref != BLOCKED and not (strategy == "text-only" and m.content_type != "text"):
                text, end = m.body, f">{ref}</acp>"
                if text.startswith("<acp ") and (k := text.find(">")) > 0 and text.startswith(end, k):
                    text = text[k + len(end) :].removeprefix("\n")
                n = t.state.snapshot.setdefault(ref, t.count(text))
                kind = (m.tool_name or "tool") if m.is_tool else m.content_type
                m = replace(m, text=f'<acp tokens="{format_short(n)}" type="{kind}">{ref}</acp>\n{text}')
            rows.append(m)
        t.messages = rows

    return Node("render-refs", run)


def default_nodes(strategy: str = "all") -> list[Node]:
    nodes = [
        Node("assign-refs", refs_node),
        Node("sync-blocks", sync_node),
        Node("prune", prune_node),
        Node("filter", filter_node, lambda t: t.config.filters_enabled and bool(filters())),
        Node("hide-compress-calls", hide_node),
        Node("recommend", recommend_node),
        Node("nudge-inject", nudge_node),
        Node("emergency-truncate", truncate_node, lambda t: t.config.model_context_limit > 0 and t.token_count / t.config.model_context_limit >= t.config.truncate_threshold),
    ]
    return nodes if strategy == "none" else [*nodes, render_node(strategy)]


def run_pipeline(nodes: list[Node], turn: Turn) -> Turn:
    for node in nodes:
        if node.enabled(turn):
            node.run(turn)
    return turn


def process_turn(messages: list[Message], state: State, config: Config, token_count: int, strategy: str = "all", count=count_tokens) -> Turn:
    """The rewritten messages, the new state and the effects; the state that came in stays as it is.  What
    is wrong with the settings is a warning and an effect, for a turn must not fail over it."""
    wrong = validate(config)
    if wrong:
        log.warning("thresholds may not fire as meant: %s", "; ".join(wrong))
    return run_pipeline(default_nodes(strategy), Turn(list(messages), state.copy(), config, token_count, count, {"config": wrong} if wrong else {}))
