"""A conversation's state as plain values that survive JSON."""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, field, replace

# Fixed values of the message format.
BLOCKED = "BLOCKED"
HEADER = "[Compressed conversation section]"
PREFIX = "acp_summary_"
MAX_REF = 99_999
_CJK = re.compile("[一-鿿぀-ヿ가-힯]")
_MESSAGE = re.compile(r"m0*(\d{1,5})", re.ASCII)
_BLOCK = re.compile(r"b(\d{1,9})", re.ASCII)


@dataclass(frozen=True)
class Message:
    id: str
    role: str
    content_type: str
    text: str | None = None
    tool_name: str | None = None
    tool_call_id: str | None = None

    @property
    def body(self) -> str:
        return self.text or ""

    @property
    def is_tool(self) -> bool:
        return self.content_type in ("tool-call", "tool-result")

    @property
    def is_summary(self) -> bool:
        return self.id.startswith(PREFIX) and self.role == "system" and self.content_type == "text"

    @property
    def answers(self) -> bool:
        """Whether reasoning may stand before it."""
        return self.role == "assistant" and self.content_type in ("text", "tool-call")


@dataclass
class Block:
    block_id: str
    run_id: str
    tier: int
    summary: str
    topic: str | None = None
    direct: list[str] = field(default_factory=list)
    covers: list[str] = field(default_factory=list)
    children: list[str] = field(default_factory=list)
    compressed_tokens: int = 0
    created_at: int = 0
    survived: int = 0
    generation: str = "young"
    active: bool = True
    call_id: str | None = None
    start_ref: str | None = None
    end_ref: str | None = None

    @property
    def number(self) -> int:
        return int(self.block_id[1:]) if re.fullmatch(r"b\d+", self.block_id) else 0


@dataclass
class State:
    blocks: list[Block] = field(default_factory=list)
    refs: dict[str, str] = field(default_factory=dict)
    snapshot: dict[str, int] = field(default_factory=dict)
    baseline: int = 0
    last_shown: int = 0
    shown: dict[int, int] = field(default_factory=dict)
    tokens_compressed: int = 0
    compressions: int = 0
    next_block: int = 1
    next_run: int = 1

    def block(self, block_id: str) -> Block | None:
        return next((b for b in self.blocks if b.block_id == block_id), None)

    @property
    def live(self) -> list[Block]:
        return [b for b in self.blocks if b.active]

    def covered(self) -> set[str]:
        return {i for b in self.live for i in b.covers}

    def by_ref(self) -> dict[str, str]:
        return {r: i for i, r in self.refs.items() if r != BLOCKED}

    def top_tier(self) -> int:
        return max((b.tier for b in self.live), default=0)

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict | None) -> State:
        """Missing fields get their defaults, unknown ones are passed over."""
        d = dict(d or {})
        known = {k: d[k] for k in cls.__dataclass_fields__ if d.get(k) is not None}
        known["blocks"] = [Block(**{k: v for k, v in b.items() if k in Block.__dataclass_fields__}) for b in d.get("blocks") or []]
        known["shown"] = {int(k): v for k, v in (d.get("shown") or {}).items()}
        return cls(**known)

    def copy(self) -> State:
        blocks = [replace(b, direct=list(b.direct), covers=list(b.covers), children=list(b.children)) for b in self.blocks]
        return replace(self, blocks=blocks, refs=dict(self.refs), snapshot=dict(self.snapshot), shown=dict(self.shown))


def units(s: str) -> int:
    """UTF-16 code units."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def count_tokens(s: str) -> int:
    cjk = 0 if s.isascii() else len(_CJK.findall(s))
    return cjk + math.ceil((units(s) - cjk) / 4)


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def make_ref(n: int) -> str:
    if not 1 <= n <= MAX_REF:
        raise ValueError(f"ref index out of bounds: {n}")
    return f"m{n:05d}"


def ref_index(ref: str | None) -> int | None:
    m = _MESSAGE.fullmatch((ref or "").strip().lower())
    return int(m[1]) if m and 1 <= int(m[1]) <= MAX_REF else None


def boundary(ref: str | None) -> tuple[str, int] | None:
    """('message', n) or ('block', n)."""
    if (n := ref_index(ref)) is not None:
        return "message", n
    m = _BLOCK.fullmatch((ref or "").strip().lower())
    return ("block", int(m[1])) if m and int(m[1]) >= 1 else None
