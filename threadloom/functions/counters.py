"""Token counts by a real vocabulary, where one is at hand."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import count_tokens, utf16_length

#: Longer texts are estimated instead.
LONGEST = 100_000
_loaded: dict[str, object] = {}


def bpe_counter(ranks: str, pattern: str) -> Callable[[Column], Column]:
    """A Column function that counts by a rank file; the estimate where the library is missing, where it
    fails, or for very long texts."""
    try:
        import tiktoken  # noqa: F401
    except ImportError:
        return count_tokens

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        import tiktoken

        if ranks not in _loaded:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[ranks] = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return pd.Series([None if t is None else len(_loaded[ranks].encode_ordinary(t)) for t in texts], dtype="Int64")

    def count(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        short = utf16_length(text) <= LONGEST
        return F.when(short, counted(F.when(short, text))).otherwise(count_tokens(text))

    return count
