"""The per-conversation plans on small conversations, and their agreement with the set-oriented operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.config import Compress, Config, Nudge, validate
from threadloom.plans.fold import Spec, assign_refs, compress, locate, rebuild, widen_reasoning, widen_tools
from threadloom.plans.protection import Range, batches, recent_zone, split_ranges
from threadloom.plans.state import Block, Message, State, boundary, count_tokens, make_ref
from threadloom.plans import turn as T

CONFIG = Config(model_context_limit=100_000, promotion_threshold=5, truncate_threshold=1, preserve_recent_messages=0, preserve_recent_tokens=0, compress=Compress(0, 0, 0), nudge=Nudge(0.55, 0.45, 0.05, 6000, 50_000, 5000, 0.45, 0.98))


def said(*ids, size=2000, role="user"):
    return [Message(i, role, "text", i * size) for i in ids]


def with_refs(messages, c=CONFIG):
    s = State()
    s.refs = assign_refs(messages, s, c)
    return s


@pytest.mark.parametrize("text, n", [("", 0), ("hello world", 3), ("function test_fn() {}", 6), ("x = 1", 2), ("你好世界", 4), ("こんにちは", 5), ("안녕하세요", 5)])
def test_token_counts(text, n):
    assert count_tokens(text) == n


def test_references():
    assert make_ref(7) == "m00007" and boundary(" M0007 ") == ("message", 7) and boundary("b3") == ("block", 3)
    assert boundary("b0") is None and boundary("m100000") is None and boundary("x1") is None
    with pytest.raises(ValueError):
        make_ref(100_000)
    rows = [Message("a", "user", "text", "x"), Message("b", "assistant", "tool-call", "x", "skill", "k"), Message("c", "user", "text", "x")]
    assert assign_refs(rows, State(), CONFIG.with_(protected_tools=("skill",))) == {"a": "m00001", "b": "BLOCKED", "c": "m00002"}


def test_one_range():
    m = said("a", "b", "c")
    free, held = split_ranges(m, with_refs(m), CONFIG, set())
    assert [(r.start_ref, r.end_ref, r.count) for r in free] == [("m00001", "m00003", 3)] and not held


def test_user_turns_split():
    m = [x for i in range(4) for x in (Message(f"u{i}", "user", "text", "q" * 40), Message(f"c{i}", "assistant", "tool-call", "{}" * 9, "bash", f"k{i}"), Message(f"r{i}", "tool", "tool-result", "out" * 9, None, f"k{i}"))]
    free, _ = split_ranges(m, with_refs(m), CONFIG, set())
    assert [(r.start_ref, r.end_ref) for r in free] == [("m00001", "m00003"), ("m00004", "m00006"), ("m00007", "m00009"), ("m00010", "m00012")]


def test_batches():
    out = batches([Range("m1", "m2", 2, 600, None, 100), Range("m3", "m5", 3, 700, None, 0)], 5000)
    assert [(r.tool_pct, r.count, r.tokens) for r in out] == [(40, 5, 1300)]
    same = [Range("m1", "m2", 2, 600)]
    assert batches(same, 0) is same and batches(same, -1) is same


@pytest.mark.parametrize("span, wider", [((0, 2), (0, 3)), ((2, 3), (1, 3))])
def test_tool_pairs(span, wider):
    m = [Message("a", "user", "text", "t"), Message("b", "assistant", "tool-call", "{}", "x", "1"), Message("c", "user", "text", "t"), Message("d", "tool", "tool-result", "o", None, "1"), Message("e", "user", "text", "t")]
    assert widen_tools(*span, m) == wider


def test_tool_pairs_on_both_sides():
    m = [Message("a", "assistant", "tool-call", "{}", "x", "1"), Message("b", "tool", "tool-result", "o", None, "1"), Message("c", "assistant", "tool-call", "{}", "x", "2"), Message("d", "user", "text", "t"), Message("e", "tool", "tool-result", "o", None, "2")]
    assert widen_tools(1, 2, m) == (0, 4)


def test_reasoning_pairs():
    m = [Message("r", "assistant", "reasoning", "hm"), Message("s", "assistant", "reasoning", "hm"), Message("t", "assistant", "text", "so"), Message("u", "user", "text", "q"), Message("v", "assistant", "reasoning", "x")]
    assert widen_reasoning(2, 3, m) == (0, 3) and widen_reasoning(0, 0, m) == (0, 2) and widen_reasoning(3, 4, m) == (3, 4)


def test_overlap_and_order():
    m = said("a", "b", "c")
    s = with_refs(m)
    out = compress([Spec("m00001", "m00002", "first"), Spec("m00002", "m00003", "second")], m, s, CONFIG)
    assert (out.created, len(out.errors), len(out.warnings)) == (1, 0, 1)
    assert s.blocks == [] and out.state.blocks[0].covers == ["a", "b"]


def test_promotion():
    m = said("a", "b", "c", "d", "e")
    one = compress([Spec("m00001", "m00002", "one")], m, with_refs(m), CONFIG).state
    two = compress([Spec("b1", "b1", "two")], m, one, CONFIG).state
    b = two.block("b2")
    assert (b.tier, b.covers, b.children, two.block("b1").active) == (2, ["a", "b"], ["b1"], False)


def test_nothing_new_is_an_error():
    m = said("a", "b", "c")
    one = compress([Spec("m00001", "m00002", "one")], m, with_refs(m), CONFIG).state
    again = compress([Spec("m00001", "m00002", "again")], m, one, CONFIG)
    assert again.created == 0 and len(again.errors) == 1


def test_size_gate_returns_the_input():
    m = said("a", "b", size=3)
    s = with_refs(m)
    out = compress([Spec("m00001", "m00002", "one")], m, s, CONFIG.with_(compress=Compress(5000, 0, 0)))
    assert out.state is s and out.errors and not out.created
    unknown = compress([Spec("m00050", "m00051", "one")], m, s, CONFIG)
    assert unknown.errors and unknown.state.next_run == 2


def test_snap_to_the_heir():
    m = said(*"abcdefghijkl")
    s = with_refs(m)
    s.blocks = [Block("b2", "r1", 1, "two", covers=["a", "b"], active=False), Block("b50", "r1", 2, "fifty", covers=["a", "b", "c"], children=["b2"]), Block("b110", "r1", 1, "last", covers=["k", "l"])]
    s.next_block = 111
    out = compress([Spec("b2", "b110", "all")], m, s, CONFIG)
    b = out.state.block("b111")
    assert (b.tier, b.children, out.state.block("b110").active, out.state.block("b50").active, len(out.warnings)) == (2, ["b110"], False, True, 1)


def test_prune():
    m = [Message("m1", "user", "text", "q"), Message("m2", "assistant", "text", "a"), Message("m3", "assistant", "text", "b"), Message("m4", "user", "text", "c")]
    s = State(blocks=[Block("b1", "r1", 1, "sum", covers=["m2", "m3"])])
    assert [x.id for x in T.prune(m, s)] == ["m1", "acp_summary_b1", "m4"]
    s.blocks[0].covers = ["m1", "m2"]
    assert [x.id for x in T.prune(m, s, inject=False)] == ["m1", "m3", "m4"]


def test_hide_calls():
    m = [Message(f"c{i}", "assistant", "tool-call", "{}", "compress", f"k{i}") for i in range(4)] + [Message("u", "user", "text", "x")]
    s = State(blocks=[Block("b1", "r1", 1, "s", covers=["u"], call_id="k0")])
    assert [x.id for x in T.hide_calls(m, s)] == ["c0", "c2", "c3", "u"]


def test_live_ranges_only():
    text = json.dumps({"content": [{"startId": "m1", "endId": "m2"}, {"startId": "m3", "endId": "m4"}], "topic": "é"})
    assert T.live_ranges_only(text, {("m1", "m2")}) == '{"content":[{"startId":"m1","endId":"m2"}],"topic":"é"}'
    assert T.live_ranges_only(text, {("m1", "m2"), ("m3", "m4")}) is None and T.live_ranges_only("no", {("a", "b")}) is None


def test_truncation():
    m = [Message(f"t{i}", "tool", "tool-result", "L" * 10_000) for i in range(2)] + [Message(f"r{i}", "tool", "tool-result", "x") for i in range(3)]
    out, cut, saved = T.truncate(m, 90_000, CONFIG.with_(truncate_threshold=0.5), len, prefix=100, suffix=100)
    assert cut >= 1 and saved > 0 and T.MARK in out[0].text
    assert T.truncate(m[:1], 90_000, CONFIG.with_(truncate_threshold=0.5), len, recent=3)[1] == 0


def test_nudges():
    c = CONFIG.with_(compress=Compress(5000, 0, 0))
    m = [Message(f"m{i}", "user", "text", f"message {i} " * 2000) for i in range(10)]
    first = T.process_turn(m, State(), c, 10_000)
    second = T.process_turn(m, first.state, c, 55_000)
    assert first.effects["nudge"]["tier"] is None and second.effects["nudge"]["tier"] == 1
    s = State(blocks=[Block(f"b{i}", "r1", 1, "s" * 24_000, covers=[f"m{i}"]) for i in range(2)])
    c = c.with_(preserve_recent_messages=9)
    one = T.process_turn(m, s, c, 50_000)
    two = T.process_turn(m, one.state, c, 60_000)
    assert two.effects["nudge"]["tier"] in (1, 2) and two.state.shown


def test_filters():
    T.clear_filters()
    T.register_filter(T.TextFilter("last", lambda text, *_: text if text.startswith("REPEAT:") else None, keep_last_only=True))
    T.register_filter(T.TextFilter("boom", lambda *_: 1 / 0))
    with pytest.raises(ValueError):
        T.register_filter(T.TextFilter("boom", lambda *_: None, version="2"))
    t = T.Turn([Message("a", "user", "text", "REPEAT:directive"), Message("b", "user", "text", "normal"), Message("c", "user", "text", "REPEAT:directive-updated")], State(), CONFIG, 0)
    T.filter_node(t)
    assert [m.text for m in t.messages] == ["", "normal", "REPEAT:directive-updated"]
    T.clear_filters()


def test_tags_are_replaced_not_stacked():
    m = said("a", "b", size=30)
    one = T.process_turn(m, State(), CONFIG, 10)
    two = T.process_turn(one.messages, one.state, CONFIG, 10)
    assert [x.text for x in two.messages] == [x.text for x in one.messages] and one.messages[0].text.startswith('<acp tokens="8" type="text">m00001</acp>\n')


def test_rebuild():
    m = said("a", "b", "c", "d")
    call = json.dumps({"content": [{"startId": "m00001", "endId": "m00002", "summary": "both"}, {"messageId": 5, "summary": "bad"}]})
    s, n = rebuild([*m, Message("x", "assistant", "tool-call", call, "compress", "k")], State(), CONFIG)
    assert n == 1 and s.block("b1").covers == ["a", "b"] and s.block("b1").call_id == "k"


def test_config_checks():
    assert validate(CONFIG) == []
    assert len(validate(Config(model_context_limit=0, promotion_threshold=0, truncate_threshold=2))) == 3


_message = st.tuples(st.sampled_from([("user", "text"), ("assistant", "text"), ("assistant", "reasoning"), ("assistant", "tool-call"), ("tool", "tool-result")]), st.sampled_from(["1", "2", "3"]), st.sampled_from([None, "read", "bash"]), st.integers(0, 40))


@settings(max_examples=120, deadline=None)
@given(st.lists(_message, max_size=25), st.lists(st.tuples(st.integers(1, 25), st.integers(1, 25)), max_size=4))
def test_invariants(rows, calls):
    m = [Message(f"i{n}", r, k, "w " * size, tool if k.startswith("tool") else None, call if k.startswith("tool") else None) for n, ((r, k), call, tool, size) in enumerate(rows)]
    c = CONFIG.with_(protected_tools=("bash",), preserve_recent_messages=1)
    s = with_refs(m, c)
    before = json.dumps(s.to_json())
    out = compress([Spec(make_ref(a), make_ref(b), "summary") for a, b in calls], m, s, c)
    assert json.dumps(s.to_json()) == before
    # Coverage from before a call stays fixed while it runs, so ranges of one call hold a message twice only where
    # one of them was widened to it.
    at = {s.refs[x.id]: i for i, x in enumerate(m) if s.refs[x.id] != "BLOCKED"}
    ends = lambda b: sorted((at[b.start_ref], at[b.end_ref]))
    held = [i for b in out.state.live for i in b.direct]
    for x in {i for i in held if held.count(i) > 1}:
        n = next(i for i, y in enumerate(m) if y.id == x)
        assert sum(ends(b)[0] <= n <= ends(b)[1] for b in out.state.live if x in b.direct) <= 1
    zone = recent_zone(m, s, c)
    assert not any(s.refs[i] in zone for b in out.state.blocks for i in b.covers)
    assert all(set(b.direct) <= set(b.covers) for b in out.state.blocks)
    t = T.process_turn(m, out.state, c, 100)
    assert json.dumps(State.from_json(json.loads(json.dumps(t.state.to_json()))).to_json()) == json.dumps(t.state.to_json())
    again = T.process_turn(m, t.state, c, 100)
    assert [x.text for x in again.messages] == [x.text for x in t.messages]


def test_set_operators_agree_with_the_plans(spark):
    """Ranges, zones and pruned views of the same conversations by both ways."""
    from threadloom.operators import coverage, ranges
    from threadloom.plans.frames import messages_of
    from threadloom.queries import CONFIG as Q
    from threadloom.sources.tables import read, sample_blocks, session_messages

    frame = session_messages(read(spark, "/root/testdata/sf0.001", "events")).cache()
    blocks = sample_blocks(frame).cache()
    refs = coverage.assign_refs(frame, patterns=Q.protected_tools).cache()
    zones, views, free = {}, {}, {}
    zone = ranges.protected_zone(frame, refs, Q, blocks)
    for r in zone.collect():
        zones.setdefault(r.conv_id, set()).add(r.ref)
    for r in coverage.prune(frame, blocks).collect():
        views.setdefault(r.conv_id, []).append((r.ord, r.id, r.text))
    for r in ranges.compressible_ranges(frame, refs, Q, blocks, zone).collect():
        free.setdefault(r.conv_id, []).append((r.n, r.start_ref, r.end_ref, r["count"], r.tokens, r.chars, r.tool_pct))
    by_conv = {k: g for k, g in frame.toPandas().groupby("conv_id")}
    own = {}
    for r in blocks.collect():
        own.setdefault(r.conv_id, []).append(Block(r.block_id, "r", r.tier, r.summary, r.topic, covers=list(r.effective_message_ids), children=list(r.direct_block_ids), active=r.active))
    for conv, pdf in by_conv.items():
        m = messages_of(pdf)
        s = State(blocks=own.get(conv, []))
        s.refs = assign_refs(m, s, Q)
        assert recent_zone(m, s, Q) == zones.get(conv, set())
        got, _ = split_ranges(m, s, Q, zones.get(conv, set()))
        assert [(i, r.start_ref, r.end_ref, r.count, r.tokens, r.chars, r.tool_pct) for i, r in enumerate(got)] == sorted(free.get(conv, []))
        assert [(x.id, x.text) for x in T.prune(m, s)] == [(i, t) for _, i, t in sorted(views[conv])]
