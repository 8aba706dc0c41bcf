"""Compression calls on one conversation: boundaries, widening, tiers, and the new blocks.

Later ranges of a call see the blocks that earlier ones made; the coverage from before the call stays
fixed meanwhile.  Input state is never changed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from threadloom.config import Config

from .protection import is_protected, recent_zone
from .state import BLOCKED, PREFIX, Block, Message, State, boundary, count_tokens, make_ref, ref_index, units


class RangeError(ValueError):
    """``kind``: unknown (never existed), consumed (hidden by a block) or invalid."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


@dataclass
class Spec:
    start_ref: str
    end_ref: str
    summary: str
    topic: str | None = None
    call_id: str | None = None
    max_chars: int | None = None


@dataclass
class Span:
    lo: int
    hi: int
    ids: list[str]
    nested: list[str]
    kind: str
    notes: list[str]


@dataclass
class Outcome:
    state: State
    created: int = 0
    tokens: int = 0
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def assign_refs(messages: list[Message], s: State, c: Config | None = None) -> dict[str, str]:
    """References with new ones for unseen ids; protected tools get none if any protection is set."""
    refs = dict(s.refs)
    guard = c is not None and bool(c.protected_tools or c.is_tool_protected)
    n = max((ref_index(r) or 0 for r in refs.values() if r != BLOCKED), default=0)
    for m in messages:
        if m.id and m.id not in refs:
            hold = guard and is_protected(m, c)
            n += not hold
            refs[m.id] = BLOCKED if hold else make_ref(n)
    return refs


def anchors(b: Block, at: dict[str, int]) -> tuple[int | None, int | None]:
    """Where its summary and its first own message are."""
    return at.get(PREFIX + b.block_id), min((at[i] for i in b.covers if i in at), default=None)


def anchor(b: Block, at: dict[str, int]) -> int | None:
    own, raw = anchors(b, at)
    return raw if own is None else own


def heir(s: State, ids: set[str], at: dict[str, int]) -> int | None:
    """The first place of an active block that took over any of ``ids`` from a block it consumed."""
    found = []
    for b in s.live:
        taken = {i for k in b.children if (child := s.block(k)) for i in child.covers}
        if taken & ids and (place := anchor(b, at)) is not None:
            found.append(place)
    return min(found, default=None)


def locate(s: State, ref: str, at: dict[str, int], by_ref: dict[str, str]) -> tuple[int, str | None, str]:
    """(position, note if it was moved to an heir, kind)."""
    parsed = boundary(ref)
    if parsed is None:
        raise RangeError("invalid", f"{ref!r} is no message or block reference")
    kind, n = parsed
    if kind == "message":
        raw = by_ref.get(ref.strip().lower()) or by_ref.get(make_ref(n))
        if raw is None:
            raise RangeError("unknown", f"{ref} does not exist in this conversation")
        if raw in at:
            return at[raw], None, kind
        ids = {raw}
    else:
        b = s.block(f"b{n}")
        if b is None:
            raise RangeError("unknown", f"{ref} does not exist in this conversation")
        if b.active and (place := anchor(b, at)) is not None:
            return place, None, kind
        ids = set(b.covers)
    if (place := heir(s, ids, at)) is None:
        raise RangeError("consumed", f"{ref} is no longer visible; a block consumed it")
    return place, f"{ref} was consumed; the active block that holds its content is taken instead", kind


def nested(s: State, at: dict[str, int], lo: int, hi: int) -> list[str]:
    return [b.block_id for b in s.live if any(p is not None and lo <= p <= hi for p in anchors(b, at))]


def resolve(spec: Spec, messages: list[Message], s: State) -> Span:
    at, by_ref = {m.id: i for i, m in enumerate(messages)}, s.by_ref()
    if boundary(spec.start_ref) is None or boundary(spec.end_ref) is None:
        raise RangeError("invalid", "both ends must be mNNNNN or bN")
    a, note_a, kind_a = locate(s, spec.start_ref, at, by_ref)
    b, note_b, kind_b = locate(s, spec.end_ref, at, by_ref)
    lo, hi = sorted((a, b))
    ids = [m.id for m in messages[lo : hi + 1] if not m.is_summary]
    return Span(lo, hi, ids, nested(s, at, lo, hi), "block" if "block" in (kind_a, kind_b) else "message", [n for n in (note_a, note_b) if n])


def widen_reasoning(lo: int, hi: int, messages: list[Message]) -> tuple[int, int]:
    """So that no answer in the range loses its reasoning, nor reasoning its answer."""
    if lo > hi or not messages:
        return lo, hi
    hi_in = min(hi, len(messages) - 1)
    end = hi_in
    if messages[hi_in].content_type == "reasoning":
        while end + 1 < len(messages) and messages[end + 1].content_type == "reasoning":
            end += 1
        end = end + 1 if end + 1 < len(messages) and messages[end + 1].answers else hi_in
    # Only the first message that isn't reasoning can have a run that begins before the range.
    first = next((i for i in range(lo, hi_in + 1) if messages[i].content_type != "reasoning"), None)
    start = lo
    if first is not None and messages[first].answers:
        while start > 0 and messages[start - 1].content_type == "reasoning":
            start -= 1
    return start, max(hi, end)


def widen_tools(lo: int, hi: int, messages: list[Message], reach: int = 20) -> tuple[int, int]:
    """So that calls and results stay together: up to ``reach`` further on, and to the first gap behind a match."""
    calls = {m.tool_call_id for m in messages[lo : hi + 1] if m.tool_call_id and m.tool_name != "compress"}

    def go(edge: int, path: range) -> int:
        best = edge
        for i in path:
            if messages[i].tool_call_id in calls:
                best = i
            elif best != edge:
                break
        return best

    if not calls:
        return lo, hi
    return go(lo, range(lo - 1, max(-1, lo - reach - 1), -1)), go(hi, range(hi + 1, min(len(messages), hi + reach + 1)))


def widen(span: Span, messages: list[Message]) -> list[str]:
    if span.kind == "block":
        return span.ids
    lo, hi = span.lo, span.hi
    for _ in range(2):
        new = widen_tools(*widen_reasoning(lo, hi, messages), messages)
        if new == (lo, hi):
            break
        lo, hi = new
    return span.ids if (lo, hi) == (span.lo, span.hi) else [m.id for m in messages[lo : hi + 1]]


def drop_protected(ids: list[str], messages: dict[str, Message], calls: set[str], c: Config) -> list[str]:
    def held(m: Message | None) -> bool:
        return m is not None and (is_protected(m, c) or (m.content_type == "tool-result" and m.tool_call_id in calls))

    return [i for i in ids if not held(messages.get(i))]


def check_summary(spec: Spec, c: Config) -> None:
    n = units((spec.summary or "").strip())
    most = c.compress.max_summary_length if spec.max_chars is None else spec.max_chars
    if n == 0:
        raise RangeError("invalid", "the summary is empty")
    if 0 < c.compress.min_summary_length > n:
        raise RangeError("invalid", f"the summary has {n} characters, fewer than {c.compress.min_summary_length}")
    if 0 < most < n:
        raise RangeError("invalid", f"the summary has {n} characters, more than {most}")


def _apply(spec: Spec, messages: list[Message], s: State, run: str, c: Config, zone: set[str], before: set[str], now: int, count) -> tuple[int, list[str]]:
    span = resolve(spec, messages, s)
    by_id, at = {m.id: m for m in messages}, {m.id: i for i, m in enumerate(messages)}
    ids = [i for i in widen(span, messages) if not i.startswith(PREFIX)]
    inside = list(span.nested)
    if len(ids) > len(span.ids):
        inside += [b for b in nested(s, at, at[ids[0]], at[ids[-1]]) if b not in inside]
    by_block = span.kind == "block"
    held = [s.block(b) for b in inside]
    tier = min((b.tier for b in held), default=1) if by_block else 1
    eaten = [b for b in held if b.active and b.tier == tier]
    covers = list(dict.fromkeys([*ids, *(i for b in eaten for i in b.covers)]))
    fresh = [i for i in covers if i not in before]
    calls = {m.tool_call_id for m in messages if m.tool_call_id and is_protected(m, c)}
    free = drop_protected(fresh, by_id, calls, c)
    recent = [i for i in free if s.refs.get(i) in zone]
    direct = [i for i in free if s.refs.get(i) not in zone]
    gone = set(fresh) - set(direct)
    covers = [i for i in covers if i not in gone]
    notes = []
    if recent:
        shown = ", ".join(s.refs[i] for i in recent)
        if not direct and not eaten:
            raise RangeError("invalid", f"all of the range is protected as recent: {shown}")
        notes.append(f"left out {len(recent)} protected message(s): {shown}")
    if not by_block and not direct and eaten:
        raise RangeError("invalid", f"nothing new in the range: {', '.join(b.block_id for b in eaten)} already cover it; name blocks to merge them")
    check_summary(spec, c)
    if not direct and not eaten:
        raise RangeError("invalid", "nothing in the range can be compressed")
    tokens = sum(count(by_id[i].body) if i in by_id else 0 for i in direct) + sum(count(b.summary) for b in eaten)
    s.blocks.append(Block(f"b{s.next_block}", run, min(3, tier + 1) if by_block else 1, spec.summary, spec.topic, direct, covers, [b.block_id for b in eaten], tokens, now, call_id=spec.call_id, start_ref=spec.start_ref, end_ref=spec.end_ref))
    s.next_block += 1
    for b in eaten:
        b.active = False
    return tokens, notes


def compress(specs: list[Spec], messages: list[Message], state: State, c: Config, zone: set[str] | None = None, now: int = 0, count=count_tokens) -> Outcome:
    """Apply one call.  Each range fails or is skipped by itself; only the size gate refuses a whole call,
    and then the state is the one that came in."""
    s = state.copy()
    run, s.next_run = f"r{s.next_run}", s.next_run + 1
    zone = recent_zone(messages, state, c, count) if zone is None else zone
    before, out = s.covered(), Outcome(s)
    spans: list[Span | RangeError] = []
    for spec in specs:
        try:
            spans.append(resolve(spec, messages, s))
        except RangeError as e:
            spans.append(e)
    name = lambda p: f"{p.start_ref}..{p.end_ref}"
    skipped, end = set(), -1
    for i in sorted((i for i, x in enumerate(spans) if isinstance(x, Span)), key=lambda i: spans[i].lo):
        if spans[i].lo <= end:
            skipped.add(i)
            out.warnings.append(f"skipped {name(specs[i])}: it overlaps an earlier range")
        else:
            end = max(end, spans[i].hi)
    failed = [(p, e) for p, e in zip(specs, spans, strict=True) if isinstance(e, RangeError)]
    if c.compress.min_compress_range > 0 and specs:
        taken = [x for i, x in enumerate(spans) if isinstance(x, Span) and i not in skipped]
        size = {m.id: units(m.body) for m in reversed(messages)}
        chars = sum(size[i] for x in taken if x.kind == "message" for i in x.ids)
        if all(x.kind == "message" for x in taken) and chars < c.compress.min_compress_range:
            eaten = [p for p, e in failed if e.kind == "consumed"]
            why = f"already compressed: {name(eaten[0])}" if eaten else "no reference resolves" if failed and not taken and not skipped and all(e.kind == "unknown" for _, e in failed) else "too little to compress"
            return Outcome(state, errors=[f"{why} ({chars} characters, at least {c.compress.min_compress_range} needed)", *[f"{name(p)}: {e}" for p, e in failed if e.kind != "consumed"]])
    for i, (spec, x) in enumerate(zip(specs, spans, strict=True)):
        if i in skipped:
            continue
        if isinstance(x, RangeError):
            (out.warnings if x.kind == "consumed" else out.errors).append(f"{name(spec)}: {x}")
            continue
        out.warnings += x.notes
        try:
            tokens, notes = _apply(spec, messages, s, run, c, zone, before, now, count)
        except RangeError as e:
            out.errors.append(f"{name(spec)}: {e}")
            continue
        out.created, out.tokens = out.created + 1, out.tokens + tokens
        out.warnings += notes
    s.compressions, s.tokens_compressed = s.compressions + out.created, s.tokens_compressed + out.tokens
    if out.created:
        s.baseline, s.last_shown, s.shown = 0, 0, {}
    return out


def specs_of(text: str | None, call_id: str | None) -> list[Spec]:
    """Ranges that a ``compress`` call's JSON asks for; what isn't well formed is passed over."""
    try:
        entries = json.loads(text or "")["content"]
    except (ValueError, TypeError, KeyError):
        return []
    out = []
    for e in entries if isinstance(entries, list) else []:
        if isinstance(e, dict) and isinstance(e.get("summary"), str):
            one = e.get("messageId")
            a, b = (one if e.get(k) is None else e[k] for k in ("startId", "endId"))
            if isinstance(a, str) and isinstance(b, str):
                out.append(Spec(a, b, e["summary"], e["topic"] if isinstance(e.get("topic"), str) else None, call_id))
    return out


def rebuild(messages: list[Message], state: State, c: Config, now: int = 0, count=count_tokens) -> tuple[State, int]:
    """State from the compress calls that a conversation itself records."""
    s, made = state.copy(), 0
    s.refs = assign_refs(messages, s)
    for m in messages:
        if m.tool_name == "compress" and m.content_type == "tool-call" and (specs := specs_of(m.text, m.tool_call_id)):
            done = compress(specs, messages, s, c, now=now, count=count)
            s, made = done.state, made + done.created
    return s, made
