"""Ids of whole texts by a ``tokenizers`` file whose pre-tokens never cross white space.

Such a tokenizer gives a text the ids of its white-space-free chunks one after the other, so
chunks are looked up in a bounded memo and only unseen ones are encoded.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

from .common import claim

#: Python splits at these, the tokenizer does not.
_UNLIKE = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[ \t\n\r\x0b\x0c]+")
#: The pre-tokens of the file's own pattern, for chunks of letters below U+0250 only.
_PRE = "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"
_LATIN = "\u0250"
#: Chunks remembered at most, and the longest of them in characters.
MEMO, MEMO_CHARS = 200_000, 64

_loaded: dict[str, WordIds] = {}


def word_ids(path: str, memo: int = MEMO) -> WordIds:
    """One encoder for each worker process and file; ``memo`` chunks are remembered at most."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    found = _loaded[path]
    found.most = memo
    claim("words", found.memo, found.known)
    return found


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies show bytes: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


_BYTES = _byte_letters()


def _shape(tok) -> bool:
    """Whether the file lower-cases, splits by ``_PRE`` and shows bytes as letters, and no more."""
    import json

    d = json.loads(tok.to_str())
    kinds = [n["type"] for n in d["normalizer"]["normalizers"]] if (d.get("normalizer") or {}).get("type") == "Sequence" else []
    pres = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norm = lambda s: s.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    return kinds == ["NFC", "Replace", "Lowercase"] and norm(pres[0].get("pattern", {}).get("Regex", "")) == _PRE and [p.get("type") for p in pres] == ["Split", "ByteLevel"] and d["post_processor"] is None


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.most = MEMO
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # Here as in the file, \x1c to \x1f are no white space.
        self.cut = regex.compile(_PRE.replace("[^\\s", "[^\\t-\\r \\x85\\xa0")).findall
        # Short cuts hold only for the file's published kind: lower case, then these pre-tokens.
        probe = "It's A1b2 né—ç!? x"
        self.latin = _shape(self.tok) and self.tok.encode(probe, add_special_tokens=False).ids == [i for c in probe.split() for i in np.frombuffer(self._latin(c), self.kind)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text in the narrowest unsigned kind; null counts as empty."""
        split = [[] if not t else [c for c in _PLAIN.split(t) if c] if _UNLIKE.search(t) else t.split() for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, now = self.memo, {}
        new = [c for c in {c for chunks in split for c in chunks} if c not in memo]
        if len(self.known) > self.most:
            self.known.clear()
        whole = [c for c in new if not (self.latin and len(c) <= MEMO_CHARS and max(c) < _LATIN and "<|" not in c)]
        done = set(whole)
        memo.update((c, self._latin(c)) for c in new if c not in done)
        for c, e in zip(whole, self.tok.encode_batch(whole, add_special_tokens=False), strict=True):
            (memo if len(c) <= MEMO_CHARS else now)[c] = np.array(e.ids, self.kind).tobytes()
        get = memo.__getitem__ if not now else lambda c: memo[c] if c in memo else now[c]
        return [np.frombuffer(b"".join(map(get, chunks)), self.kind) for chunks in split]

    def _latin(self, chunk: str) -> bytes:
        """A short chunk without marks to compose: lower case, cut, and merge by the file's model alone."""
        known, out = self.known, []
        for p in self.cut(chunk.lower()):
            ids = known.get(p)
            if ids is None:
                shown = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTES)
                ids = known[p] = array(self.code, [t.id for t in self.tok.model.tokenize(shown)]).tobytes()
            out.append(ids)
        return b"".join(out)
