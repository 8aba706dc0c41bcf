"""Which messages of a list are protected, and the ranges that remain."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from threadloom.config import Config

from .state import BLOCKED, HEADER, Message, State, count_tokens, half_up, units

#: Tools whose results never count as recent.
_LEFT_OUT = ("decompress", "search_context", "read", "bash")


def is_protected(m: Message, c: Config) -> bool:
    if not m.is_tool or not m.tool_name:
        return False
    named = m.tool_name == "compress" or any(m.tool_name.startswith(p[:-1]) if p.endswith("*") else m.tool_name == p for p in c.protected_tools)
    return named or bool(c.is_tool_protected and c.is_tool_protected(m.tool_name, m.text))


def protected_calls(messages: list[Message], c: Config) -> set[str]:
    return {m.tool_call_id for m in messages if m.content_type == "tool-call" and m.tool_call_id and is_protected(m, c)}


def still_open(messages: list[Message], s: State) -> list[Message]:
    covered = s.covered()
    return [m for m in messages if m.id not in covered and not m.body.startswith(HEADER)]


def recent_zone(messages: list[Message], s: State, c: Config, count=count_tokens) -> set[str]:
    """References at the end that stay: the last messages, the last tokens, the last user message."""
    free = still_open(messages, s)
    named = [(s.refs.get(m.id), count(m.body)) for m in free if not (m.is_tool and m.tool_name in _LEFT_OUT)]
    tail = [(r, n) for r, n in reversed(named) if r and r != BLOCKED]
    before = accumulate((n for _, n in tail), initial=0)
    kept = {r for r, _ in tail[: max(0, c.preserve_recent_messages)]} | {r for (r, _), n in zip(tail, before, strict=False) if n < c.preserve_recent_tokens}
    if c.preserve_recent_messages > 0:
        last = next((s.refs.get(m.id) for m in reversed(free) if m.role == "user"), None)
        kept |= {last} if last and last != BLOCKED else set()
    return kept


@dataclass
class Range:
    start_ref: str
    end_ref: str
    count: int
    tokens: int
    chars: int | None = None
    tool_pct: int = 0
    dangerous: bool = False
    tools: list[str] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.tokens * 4 if self.chars is None else self.chars


def split_ranges(messages: list[Message], s: State, c: Config, zone: set[str], count=count_tokens) -> tuple[list[Range], list[Range]]:
    """(compressible, protected)."""
    calls = protected_calls(messages, c)
    free, held, last = [], [], {"free": -2, "held": -2}
    for m in still_open(messages, s):
        ref = s.refs.get(m.id)
        if not ref or ref == BLOCKED:
            continue
        n, tokens, chars = int(ref[1:]), count(m.body), units(m.body)
        if is_protected(m, c) or (m.content_type == "tool-result" and m.tool_call_id in calls):
            if not held or n > last["held"] + 1:
                held.append(Range(ref, ref, 0, 0))
            r, last["held"] = held[-1], n
            r.tools += [m.tool_name] if m.tool_name and m.tool_name not in r.tools else []
        elif ref in zone:
            continue
        else:
            if not free or n > last["free"] + 1 or (m.role == "user" and free[-1].count >= 3):
                free.append(Range(ref, ref, 0, 0, 0))
            r, last["free"] = free[-1], n
            r.chars += chars
            r.tool_pct = half_up((r.tool_pct * r.count + 100 * m.is_tool) / (r.count + 1))
        r.end_ref, r.count, r.tokens = ref, r.count + 1, r.tokens + tokens
    return [r for r in free if r.tokens > 0], held


def batches(ranges: list[Range], least: int) -> list[Range]:
    """Neighbours joined until each has ``least`` characters."""
    if least <= 0 or not ranges:
        return ranges
    groups: list[list[Range]] = [[]]
    for r in ranges:
        if groups[-1] and sum(x.size for x in groups[-1]) >= least:
            groups.append([])
        groups[-1].append(r)
    out = []
    for g in groups:
        n = sum(r.count for r in g)
        out.append(Range(g[0].start_ref, g[-1].end_ref, n, sum(r.tokens for r in g), sum(r.size for r in g), half_up(sum(r.tool_pct * r.count for r in g) / n), any(r.dangerous for r in g)))
    return out
