"""Token estimates, references, boundaries and number formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges counted one token a character, and the protocol's literals.
CJK_TOKENS = "[一-鿿぀-ヿ가-힯]"
SUMMARY_HEADER = "[Compressed conversation section]"
SUMMARY_PREFIX = "acp_summary_"
BLOCKED = "BLOCKED"
MAX_REF = 99_999


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def utf16_length(c) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(_text(c), "UTF-16LE")) / 2).cast("long")


def count_tokens(c) -> Column:
    """One token a CJK character, a quarter for each other code unit, rounded up."""
    cjk = F.regexp_count(_text(c), F.lit(CJK_TOKENS))
    return (cjk + F.ceil((utf16_length(c) - cjk) / 4)).cast("long")


def count_tokens_fast(c) -> Column:
    return F.ceil(utf16_length(c) / 4).cast("long")


def index_to_ref(n: Column) -> Column:
    """``m`` and five digits; beyond 99999 or below 1 the query fails."""
    wrong = F.raise_error(F.concat(F.lit("ref index out of bounds: "), n.cast("string")))
    return F.when((n < 1) | (n > MAX_REF), wrong.cast("string")).otherwise(F.concat(F.lit("m"), F.lpad(n.cast("string"), 5, "0")))


def ref_to_index(c) -> Column:
    """Null for what is no reference."""
    digits = F.regexp_extract(F.lower(F.trim(_text(c))), "^m0*(\\d{1,5})$", 1)
    n = digits.try_cast("int")
    return F.when(n.between(1, MAX_REF), n)


def parse_boundary(c) -> Column:
    """struct(kind, number), null if it is neither a message nor a block."""
    low = F.lower(F.trim(_text(c)))
    block = F.regexp_extract(low, "^b(\\d{1,9})$", 1).try_cast("int")
    number = F.coalesce(ref_to_index(c), F.when(block >= 1, block))
    kind = F.when(ref_to_index(c).isNotNull(), F.lit("message")).otherwise(F.lit("block"))
    return F.when(number.isNotNull(), F.struct(kind.alias("kind"), number.alias("number")))


def ref_number(c) -> Column:
    """Digits after the first character; -1 if there are none."""
    return F.coalesce(F.regexp_extract(F.substring(_text(c), 2, 1 << 30), "^\\s*([+-]?\\d+)", 1).try_cast("int"), F.lit(-1))


def block_number(c) -> Column:
    return F.coalesce(F.regexp_extract(_text(c), "^b(\\d+)$", 1).try_cast("int"), F.lit(0))


def block_id_argument(c) -> Column:
    """``b007``, ``7`` and the like to ``b7``."""
    digits = F.regexp_extract(F.lower(F.trim(_text(c))), "^(?:b0*)?(\\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("b"), digits))


def occurrences(hay: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    if not needle:
        return F.lit(0)
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def percent(part: Column, total: Column) -> Column:
    """Whole percent, at least 1 for what is there at all.  Times 100 comes first: a share of 28.5 stays one."""
    return F.when((part <= 0) | (total <= 0), 0).otherwise(F.greatest(F.lit(1), F.floor(part * 100 / total + 0.5))).cast("int")


def clamp_growth(limit: Column, ratio: float, floor: int, cap: int) -> Column:
    grown = F.least(F.lit(cap), F.greatest(F.lit(floor), F.floor(limit * ratio + 0.5)))
    return F.when(limit.isNull() | (limit <= 0), F.lit(floor)).otherwise(grown).cast("long")


def tool_matches(name: Column, patterns: tuple[str, ...]) -> Column:
    """Equality, or a beginning for patterns that end in ``*``."""
    out = F.lit(False)
    for p in patterns:
        out = out | (name.startswith(p[:-1]) if p.endswith("*") else name == p)
    return out


def is_tool() -> Column:
    return F.col("content_type").isin("tool-call", "tool-result")


def is_protected(patterns: tuple[str, ...] = ()) -> Column:
    """A named tool message whose tool is ``compress`` or matches a pattern."""
    name = F.col("tool_name")
    return F.coalesce(is_tool() & (name != "") & ((name == "compress") | tool_matches(name, patterns)), F.lit(False))


def never_recent() -> Column:
    return F.coalesce(is_tool() & F.col("tool_name").isin("decompress", "search_context", "read", "bash"), F.lit(False))


def rendered_summary() -> Column:
    return F.col("id").startswith(SUMMARY_PREFIX) & (F.col("role") == "system") & (F.col("content_type") == "text")


def message_kind() -> Column:
    """What a tag names: the tool, or the content type."""
    return F.when(is_tool(), F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.lit("tool"))).otherwise(F.col("content_type"))


def content_id() -> Column:
    """Content hash of a message; missing parts are empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "content_type", "tool_call_id", "tool_name", "text")]
    return F.concat(F.lit("h_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def topic_fallback(c) -> Column:
    """The summary's first clause without quotes, cut at 30 characters."""
    first = F.trim(F.regexp_replace(F.split(_text(c), "[.\\n]").getItem(0), "[\"'`]", ""))
    return F.when(F.length(first) > 30, F.concat(F.substring(first, 1, 30), F.lit("…"))).otherwise(first)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is all zero or the lengths differ."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    d = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    dot = add(F.zip_with(*d, lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(d[0], lambda x: x * x))) * F.sqrt(add(F.transform(d[1], lambda x: x * x)))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot / norm)
