"""A conversation's state across micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.config import Config
from threadloom.plans.frames import DECIDED, FIELDS, decided, decided_schema, fold_request, messages_of
from threadloom.plans.state import Message, State
from threadloom.plans.turn import process_turn
from threadloom.sources.grouped import by_key

_OUT = "conv_id {kind}, messages long, token_count long, refs long, baseline long, tier int"


def _advance(rows: list, seen: list[dict], state: State, config: Config) -> tuple[list[dict], State, int | None, int]:
    known = {m["id"] for m in seen}
    seen = seen + [vars(m) for m in rows if m.id not in known]
    whole = [Message(**m) for m in seen]
    count = sum(-(-len(m.body) // 4) for m in whole)
    t = process_turn(whole, state, config, count, "none")
    return seen, t.state, t.effects["nudge"]["tier"], count


def stream_turns(messages: DataFrame, config: Config) -> DataFrame:
    """One row for each conversation and micro-batch: what the turn decided.  State is the messages so far
    and the conversation's own; messages that come twice count once."""
    kind = dict(messages.dtypes)["conv_id"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(held.get[0]) if held.exists else {"messages": [], "state": {}}
        parts = list(batches)
        rows = messages_of(pd.concat(parts)) if parts else []
        seen, state, tier, count = _advance(rows, old["messages"], State.from_json(old["state"]), config)
        held.update((json.dumps({"messages": seen, "state": state.to_json()}, ensure_ascii=False),))
        out = pd.DataFrame({"conv_id": [key[0]], "messages": [len(seen)], "token_count": [count], "refs": [len(state.refs)], "baseline": [state.baseline], "tier": [tier]})
        yield out.astype({"tier": "Int32"})

    return messages.groupBy("conv_id").applyInPandasWithState(run, _OUT.format(kind=kind), "state string", "update", GroupStateTimeout.NoTimeout)


def batch_turns(messages: DataFrame, config: Config) -> DataFrame:
    """The same over a finished table: each conversation as one micro-batch."""
    kind = dict(messages.dtypes)["conv_id"]

    def run(key, group: list[tuple]) -> list[tuple]:
        seen, state, tier, count = _advance([Message(*r[2:]) for r in group], [], State(), config)
        return [(key, len(seen), count, len(state.refs), state.baseline, tier)]

    return by_key(messages.select("conv_id", "ord", *FIELDS), "conv_id", ["ord"], run, _OUT.format(kind=kind))


def stream_requests(requests: DataFrame, config: Config, idle: str | None = None) -> DataFrame:
    """One row for each request of a stream, as ``frames.turn_sequence`` gives for a table.

    A request carries its whole conversation, so only the conversation's own state is kept, and messages
    that vanish between requests take their blocks with them.  Requests of one micro-batch run in
    the order of ``request``; one that is not newer than the last is passed over, so a replay changes nothing.
    With ``idle`` (a duration) a conversation's state goes after that time without requests.
    """
    kinds = dict(requests.dtypes)["conv_id"], dict(requests.dtypes)["request"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, state = (held.get[0], State.from_json(json.loads(held.get[1]))) if held.exists else (None, State())
        out = []
        for request, rows in pd.concat(list(parts)).groupby("request", sort=True):
            if last is None or request > last:
                t, count = fold_request(messages_of(rows), state, config)
                state, last = t.state, int(request)
                out.append(decided(key[0], request, rows, t, count))
        held.update((last, json.dumps(state.to_json(), ensure_ascii=False)))
        if idle:
            held.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=DECIDED).astype({"tier": "Int32"})

    limit = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return requests.groupBy("conv_id").applyInPandasWithState(run, decided_schema(*kinds), "last long, state string", "append", limit)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An addition of ours: events by user and session window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
