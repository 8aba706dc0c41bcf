"""The per-conversation plans over DataFrames: a stream of conversations in each task.

A group is one conversation, some thousand messages at most; no group spans conversations, so
a large source only means more groups.
"""

from __future__ import annotations

import json
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.sources.grouped import by_key

from .fold import Spec, assign_refs, compress, rebuild, specs_of
from .state import Message, State
from .turn import TextFilter, Turn, clear_filters, process_turn, register_filter

FIELDS = ("id", "role", "content_type", "text", "tool_name", "tool_call_id")


def messages_of(pdf: pd.DataFrame) -> list[Message]:
    rows = pdf.sort_values("ord", kind="stable")[list(FIELDS)].astype(object)
    return [Message(*r) for r in rows.where(rows.notna(), None).itertuples(index=False)]


def turns(messages: DataFrame, config: Config, strategy: str = "all", text_filters: tuple[TextFilter, ...] = ()) -> DataFrame:
    """The view of each conversation after one turn: (conv_id, ord, id, role, content_type, text, tier, state).
    ``text_filters`` are the turn's filters in order; a registry of the driver's process doesn't reach workers."""

    def run(key, group: list[tuple]) -> list[tuple]:
        clear_filters()
        for f in text_filters:
            register_filter(f)
        rows = [Message(*r[2:]) for r in group]
        count = sum(-(-len(m.body) // 4) for m in rows)
        t = process_turn(rows, State(), config, count, strategy)
        state = json.dumps(t.state.to_json(), ensure_ascii=False, sort_keys=True)
        return [(key, i, m.id, m.role, m.content_type, m.text, t.effects["nudge"]["tier"], state if i == 0 else None) for i, m in enumerate(t.messages)]

    kind = dict(messages.dtypes)["conv_id"]
    return by_key(messages.select("conv_id", "ord", *FIELDS), "conv_id", ["ord"], run, f"conv_id {kind}, ord long, id string, role string, content_type string, text string, tier int, state string")


def rebuilt_blocks(messages: DataFrame, config: Config, now: int = 0) -> DataFrame:
    """Blocks from the compress calls that conversations record."""

    def run(key, group: list[tuple]) -> list[tuple]:
        state, _ = rebuild([Message(*r[2:]) for r in group], State(), config, now)
        return [(key, b.block_id, b.tier, b.topic, b.summary, b.direct, b.covers, b.children, b.compressed_tokens, b.active, b.start_ref, b.end_ref) for b in state.blocks]

    kind = dict(messages.dtypes)["conv_id"]
    ids = "direct_message_ids array<string>, effective_message_ids array<string>, direct_block_ids array<string>"
    return by_key(messages.select("conv_id", "ord", *FIELDS), "conv_id", ["ord"], run, f"conv_id {kind}, block_id string, tier int, topic string, summary string, {ids}, compressed_tokens long, active boolean, start_ref string, end_ref string")


_CALL = ["call", "pos", "start_ref", "end_ref", "summary", "topic", "call_id"]


def apply_calls(messages: DataFrame, calls: DataFrame, config: Config, states: DataFrame | None = None, now: int = 0) -> DataFrame:
    """Compression calls on whole tables: a row for each call with what came of it and the state after it.

    ``calls`` has conv_id, call (their order), pos (of a range in its call), start_ref, end_ref, summary and
    perhaps topic and call_id; ``states(conv_id, state)`` are the states before, new ones where a
    conversation has none.  Calls on a conversation without messages fail by themselves.
    (conv_id, call, created, tokens, errors, warnings, state JSON).
    """
    # One table of three kinds of rows, in this order within a conversation: state before, messages, ranges of calls.
    none = lambda rows, names: [F.lit(None).cast(rows.schema[c].dataType if c in rows.columns else "string").alias(c) for c in names]
    shape = ["conv_id", "_kind", "ord", *FIELDS, *_CALL, "state"]
    parts = [
        messages.join(calls.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.lit(1).alias("_kind"), "ord", *FIELDS, *none(calls, _CALL), F.lit(None).cast("string").alias("state")),
        calls.select("conv_id", F.lit(2).alias("_kind"), *none(messages, ["ord", *FIELDS]), *[F.col(c) if c in calls.columns else F.lit(None).cast("string").alias(c) for c in _CALL], F.lit(None).cast("string").alias("state")),
    ]
    if states is not None:
        parts.append(states.select("conv_id", F.lit(0).alias("_kind"), *none(messages, ["ord", *FIELDS]), *none(calls, _CALL), "state"))
    every = parts[0].select(shape)
    for p in parts[1:]:
        every = every.unionByName(p)
    text, call = shape.index("id"), shape.index("call")

    def run(key, group: list[tuple]) -> list[tuple]:
        asked = [r[call : call + len(_CALL)] for r in group if r[1] == 2 and r[call] is not None]
        if not asked:
            return []
        old = next((r[-1] for r in group if r[1] == 0 and r[-1] is not None), None)
        state = State() if old is None else State.from_json(json.loads(old))
        rows = [Message(*r[text : text + len(FIELDS)]) for r in group if r[1] == 1]
        state.refs = assign_refs(rows, state, config)
        out = []
        for at, specs in groupby(asked, lambda r: r[0]):
            done = compress([Spec(*r[2:]) for r in specs], rows, state, config, now=now)
            state = done.state
            out.append((key, at, done.created, done.tokens, done.errors, done.warnings, json.dumps(state.to_json(), ensure_ascii=False)))
        return out

    kinds = dict(messages.dtypes)["conv_id"], dict(calls.dtypes)["call"]
    return by_key(every, "conv_id", ["_kind", "ord", "call", "pos"], run, f"conv_id {kinds[0]}, call {kinds[1]}, created int, tokens long, errors array<string>, warnings array<string>, state string")


def blocks_of(states: DataFrame) -> DataFrame:
    """The blocks of ``states(conv_id, state)``, a row each, as ``sources.tables`` describes them."""
    block = "block_id string, tier int, topic string, summary string, direct array<string>, covers array<string>, children array<string>, compressed_tokens long, survived int, generation string, active boolean, call_id string, start_ref string, end_ref string"
    rows = states.select("conv_id", F.explode(F.from_json("state", f"blocks array<struct<{', '.join(c.replace(' ', ': ', 1) for c in block.split(', '))}>>")["blocks"]).alias("b"))
    names = {"direct": "direct_message_ids", "covers": "effective_message_ids", "children": "direct_block_ids", "survived": "survived_count", "call_id": "compress_call_id"}
    picked = [F.col(f"b.{c.split(' ')[0]}").alias(names.get(c.split(" ")[0], c.split(" ")[0])) for c in block.split(", ")]
    return rows.select("conv_id", *picked).withColumn("block_num", F.substring("block_id", 2, 9).cast("int"))


def fold_request(rows: list[Message], state: State, config: Config, strategy: str = "none") -> tuple[Turn, int]:
    """One request of a conversation, which carries all of its messages: compress calls that the state
    doesn't know yet are applied, then the turn runs.  (turn, token count)."""
    state = state.copy()
    state.refs = assign_refs(rows, state, config)
    known = {b.call_id for b in state.blocks}
    for m in rows:
        if m.tool_name == "compress" and m.content_type == "tool-call" and m.tool_call_id not in known and (specs := specs_of(m.text, m.tool_call_id)):
            state = compress(specs, rows, state, config).state
    count = sum(-(-len(m.body) // 4) for m in rows)
    return process_turn(rows, state, config, count, strategy), count


def turn_sequence(requests: DataFrame, config: Config) -> DataFrame:
    """All requests of each conversation in order, the state going from one to the next: ``requests`` are
    messages with a column ``request``, each with the whole conversation at that time.  Messages without that column
    make a request each, named by its ``ord``: the conversation up to it.
    (conv_id, request, messages, token_count, growth, baseline, last_shown, tier, active, lost)."""
    growing = "request" not in requests.columns

    def asked(group: list[tuple]):
        if growing:
            rows = [Message(*r[3:]) for r in group]
            yield from ((at, rows[: list(same)[-1][0] + 1]) for at, same in groupby(enumerate(group), lambda r: r[1][1]))
        else:
            yield from ((at, [Message(*r[3:]) for r in rows]) for at, rows in groupby(group, lambda r: r[1]) if at is not None)

    def run(key, group: list[tuple]):
        state = State()
        for request, rows in asked(group):
            t, count = fold_request(rows, state, config)
            state = t.state
            yield decided(key, request, rows, t, count)

    rows = requests.select("conv_id", F.col("ord").alias("request") if growing else "request", "ord", *FIELDS)
    kinds = dict(rows.dtypes)["conv_id"], dict(rows.dtypes)["request"]
    return by_key(rows, "conv_id", ["request", "ord"], run, decided_schema(*kinds))


DECIDED = ["conv_id", "request", "messages", "token_count", "growth", "baseline", "last_shown", "tier", "active", "lost"]


def decided_schema(conv: str, request: str) -> str:
    return f"conv_id {conv}, request {request}, messages long, token_count long, growth long, baseline long, last_shown long, tier int, active array<string>, lost array<string>"


def decided(conv, request, rows, t: Turn, count: int) -> tuple:
    """A row of what a turn decided."""
    n, s = t.effects["nudge"], t.state
    return conv, request, len(rows), count, n["growth"], s.baseline, s.last_shown, n["tier"], [b.block_id for b in s.live], t.effects["deactivated"]
