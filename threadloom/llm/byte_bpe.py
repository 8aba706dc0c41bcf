"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

The model's pieces are the vocabulary's byte strings, each byte shown as one letter from U+0100
on; a piece's id is its rank and its score the negative rank, so the merge of the best score is
the merge of the lowest rank, the leftmost first, as in the rank file's own algorithm.  The
normaliser is the identity.  Texts are cut into pre-tokens by the public pattern; a pre-token that
is itself in the vocabulary is its one id, others go through the model.  Decoding maps ids back
to their bytes.

Null texts are empty and have no ids; null doc_ids stay; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, slices

_SHIFT = {b: 0x100 + b for b in range(256)}
#: White space as the pattern's engine has it (the Unicode property White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts where the pattern always cuts: before the last blank of a run and at its other white space.
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
MEMO, MEMO_CHARS = 200_000, 64


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_SHIFT)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces 1 (text 1, score 2, type 3), trainer 2, normaliser 3."""
    by_id = {r: b for b, r in ranks.items()}
    size = max(by_id) + 1
    out = []
    for i in range(size):
        piece = letters(by_id[i]) if i in by_id else f"{i}"  # a gap in the ranks: a piece no text has
        out.append(_field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -i) + _flag(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", -size) + _flag(3, 2)))
    out.append(_field(2, _flag(3, 2) + _flag(4, size + 1)))  # model_type BPE, vocab_size
    out.append(_field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)))
    return b"".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process, rank file and pattern."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    found = _loaded[path, pattern]
    claim("bytes", found.memo, found.known)
    return found


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = load_ranks(path)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            self.pieces[r] = b
        self.kind = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\s", f"[{_WS}]").replace(r"\S", f"[^{_WS}]")).findall
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_COARSE.findall(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, now = self.memo, {}
        new = [c for c in {c for chunks in split for c in chunks} if c not in memo]
        cut = [self.cut(c) for c in new]
        if len(self.known) > MEMO:
            self.known.clear()
        ids = self.known if all(len(c) <= MEMO_CHARS for c in new) else dict(self.known)
        hard = list({p for ps in cut for p in ps if p not in ids})
        pack = lambda x: np.array(x, self.kind).tobytes()
        pieces = [p.encode() for p in hard]
        merged = [(p, letters(b)) for p, b in zip(hard, pieces, strict=True) if b not in self.ranks]
        ids.update((p, pack([self.ranks[b]])) for p, b in zip(hard, pieces, strict=True) if b in self.ranks)
        if merged:
            ids.update((p, pack(x)) for (p, _), x in zip(merged, self.model.encode([s for _, s in merged], num_threads=1), strict=True))
        for c, ps in zip(new, cut, strict=True):
            (memo if len(c) <= MEMO_CHARS else now)[c] = b"".join([ids[p] for p in ps])
        get = memo.__getitem__ if not now else lambda c: memo[c] if c in memo else now[c]
        return [np.frombuffer(b"".join(map(get, chunks)), self.kind) for chunks in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(ranks, pattern)
        for b in slices(batches):
            ids = [x.astype(np.int32) for x in codec.encode(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(ranks, pattern)
        for b in slices(batches):
            data = [b"".join(codec.pieces[i] for i in x or ()) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(ranks, pattern)
        for b in slices(batches):
            ids = codec.encode(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
