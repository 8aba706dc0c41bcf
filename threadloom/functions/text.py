"""Tokens, stems and bigrams of search texts as Column expressions; whole texts are counted in one Arrow function."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Set
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern and the ranges that count as CJK in search.
WORD = "[a-z][a-z0-9_]*[a-z0-9]|[a-z0-9]"
#: Words of two signs or more among those; what a pattern without the single signs finds is the same.
LONGER = "[a-z][a-z0-9_]*[a-z0-9]"
CJK = "[㐀-鿿豈-﫿぀-ヿ가-힯]"


def _cut(w: Column, n: int, add: str = "") -> Column:
    out = F.substring(w, F.lit(1), F.length(w) - n)
    return F.concat(out, F.lit(add)) if add else out


def _rule(w: Column, *cases: tuple[Column, Column]) -> Column:
    out = F
    for cond, then in cases:
        out = out.when(cond, then)
    return out.otherwise(w)


#: Suffix rules, stage by stage; within a stage the first that fits applies.
_STAGES = [
    lambda w: _rule(
        w,
        (w.endswith("ies"), _cut(w, 3, "y")),
        (w.endswith("ses") | w.endswith("xes") | w.endswith("zes") | w.endswith("ches") | w.endswith("shes"), _cut(w, 2)),
        (w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)),
    ),
    lambda w: _rule(w, (w.endswith("ing") & (F.length(w) > 5), _cut(w, 3))),
    lambda w: _rule(w, (w.endswith("ed") & (F.length(w) > 4), _cut(w, 2))),
    lambda w: _rule(
        w,
        (w.endswith("ation") & (F.length(w) > 6), _cut(w, 3)),
        (w.endswith("tion") & (F.length(w) > 5), _cut(w, 4, "t")),
        (w.endswith("ion") & (F.length(w) > 4), _cut(w, 3)),
    ),
    lambda w: _rule(w, (w.endswith("ment") & (F.length(w) > 6), _cut(w, 4))),
    lambda w: _rule(w, (w.endswith("ness") & (F.length(w) > 6), _cut(w, 4))),
    lambda w: _rule(w, (w.endswith("ly") & (F.length(w) > 4), _cut(w, 2))),
]


def _apply(stage):
    return lambda s: F.struct(F.when(s["long"], stage(s["w"])).otherwise(s["w"]).alias("w"), s["long"].alias("long"))


def stems(words: Column) -> Column:
    """Each word of an array without its suffixes; words of up to three letters stay.  A stage is a
    ``transform`` of its own, so that expressions don't grow with the number of stages."""
    out = F.transform(words, lambda w: F.struct(w.alias("w"), (F.length(w) > 3).alias("long")))
    for stage in _STAGES:
        out = F.transform(out, _apply(stage))
    return F.transform(out, lambda s: s["w"])


def stem(word: Column) -> Column:
    return stems(F.array(word))[0]


def words(text: Column) -> Column:
    """Latin words of two or more characters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONGER), F.lit(0))


def cjk_tokens(text: Column) -> Column:
    """Runs of CJK characters as bigrams and characters: the fallback where no dictionary is at hand."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{CJK}+"), F.lit(0))
    grams = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    chars = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))
    return F.flatten(F.transform(runs, lambda r: F.concat(grams(r), chars(r))))


def tokens(text: Column, stemmed: bool = True) -> Column:
    latin = words(text)
    return F.concat(stems(latin) if stemmed else latin, F.when(text.rlike(CJK), cjk_tokens(text)).otherwise(F.array().cast("array<string>")))


def n_tokens(text: Column) -> Column:
    """How many :func:`tokens` a text has, without making them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_count(low, F.lit(LONGER)) + F.when(text.rlike(CJK), F.size(cjk_tokens(text))).otherwise(0)


def bigrams(text: Column) -> Column:
    """Character pairs without blanks at their ends; a look-ahead gives overlapping ones in linear time."""
    return F.regexp_extract_all(text, F.lit("(?U)(?=(\\S\\S))"), F.lit(1))


def stem_word(w: str) -> str:
    """The same rules for one word, in Python."""
    if len(w) <= 3:
        return w
    for ending, n, add in (("ies", 3, "y"), ("ses", 2, ""), ("xes", 2, ""), ("zes", 2, ""), ("ches", 2, ""), ("shes", 2, ""), ("s", 1, "")):
        if w.endswith(ending) and not (ending == "s" and w.endswith("ss")):
            w = w[:-n] + add
            break
    for stage in ((("ing", 5, 3, ""),), (("ed", 4, 2, ""),), (("ation", 6, 3, ""), ("tion", 5, 4, "t"), ("ion", 4, 3, "")), (("ment", 6, 4, ""),), (("ness", 6, 4, ""),), (("ly", 4, 2, ""),)):
        for ending, longer, n, add in stage:
            if w.endswith(ending) and len(w) > longer:
                w = w[:-n] + add
                break
    return w


#: All bytes but the word signs become blanks.
_SIGNS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))
#: What runs of word signs have been stemmed to in this process: as many are kept, each of so many bytes, at most.
_known: dict[bytes, str] = {}
KNOWN, RUN = 1 << 18, 64


def _term_of(run: bytes) -> str:
    """A run of word signs is one word from its first letter to its last letter or digit; empty if that is no word."""
    if (term := _known.get(run)) is None:
        word = run.lstrip(b"0123456789_").rstrip(b"_").decode("ascii")
        term = stem_word(word) if len(word) >= 2 else ""
        if len(run) <= RUN:
            if len(_known) >= KNOWN:
                _known.clear()
            _known[run] = term
    return term


def count_terms(low: str, only: Set[str] | None = None) -> tuple[int, dict[str, int]]:
    """(number of tokens, terms by how often they occur) of a lower-case text, those in ``only`` if it is given: what
    :func:`tokens` has, counted in one go."""
    runs = low.encode("utf-8", "surrogatepass").translate(_SIGNS).split()
    found = Counter(map(_known.get, runs))
    if found.pop(None, 0):
        for run, times in Counter(filterfalse(_known.__contains__, runs)).items():
            found[_term_of(run)] += times
    found.pop("", 0)
    for run in [] if low.isascii() else re.findall(f"{CJK}+", low):
        found.update([run[i : i + 2] for i in range(len(run) - 1)] + list(run))
    return sum(found.values()), found if only is None else {t: found[t] for t in found.keys() & only}


def term_counts(text: Column, only: Iterable[str] | None = None, parts: Iterable[str] = ()) -> Column:
    """struct(len, terms, tf, parts): how many tokens a text has, its distinct terms and how often each occurs, and how
    many of ``parts`` are in it.  Each text is counted where it is, so its words are no rows until they are counted."""
    only, parts = None if only is None else frozenset(only), tuple(parts)

    @F.arrow_udf("struct<len: int, terms: array<string>, tf: array<int>, parts: int>")
    def run(texts: pa.Array) -> pa.Array:
        sizes, ends, terms, times, within = [], [0], [], [], []
        for low in (t.as_py() for t in texts):
            n, found = count_terms(low, only)
            sizes.append(n)
            within.append(sum(p in low for p in parts))
            terms += found
            times += found.values()
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, a) for a in (pa.array(terms, pa.string()), pa.array(times, pa.int32()))]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), *lists, pa.array(within, pa.int32())], ["len", "terms", "tf", "parts"])

    return run(F.lower(F.coalesce(text, F.lit(""))))


def query_tokens(query: str, stemmed: bool = True) -> list[str]:
    low = query.lower()
    out = [stem_word(w) if stemmed else w for w in re.findall(WORD, low) if len(w) >= 2]
    for run in re.findall(f"{CJK}+", low):
        out += [run[i : i + 2] for i in range(len(run) - 1)] + list(run)
    return out


def query_bigrams(query: str) -> list[str]:
    """Distinct pairs of the query's longer words, in order."""
    parts = [t for t in re.split(r"[\s,]+", query.lower()) if len(t) >= 4 or (len(t) >= 2 and re.search(CJK, t))]
    pairs = [t[i : i + 2] for t in parts for i in range(len(t) - 1)]
    return list(dict.fromkeys(p for p in pairs if p.strip() == p))


def preview(text: Column, query: str, size: int = 200) -> Column:
    """A window around the first query term that occurs, with ellipses where it was cut."""
    terms = [t for t in query.lower().split() if len(t) > 1]
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    hit = F.coalesce(*[F.when(F.locate(t, low) > 0, F.locate(t, low) - 1) for t in terms], F.lit(-1)) if terms else F.lit(-1)
    start = F.greatest(F.lit(0), hit - max(0, size // 2 - 10))
    end = F.least(F.length(text), start + size)
    cut = F.regexp_replace(F.substring(text, start + 1, end - start), "(?U)^\\s+|\\s+$", "")
    around = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(hit < 0, F.substring(text, 1, size)).otherwise(around)
