"""WARC archives, one Zstandard frame for each record behind a dictionary in a skippable frame.

Writing: payloads are grouped by SHA-256 and length; of a group the record with the largest page_id
is a ``response``, the others are ``revisit`` records that refer to it and carry its HTTP header
alone.  Each task trains a dictionary on its first records (a bounded sample), writes it into the
leading skippable frame and then one frame for each record.  Reading: the dictionary is loaded
from that frame, frames are decoded one at a time, and versions, header lines, lengths and digests
are checked; an archive that breaks any rule raises ``ValueError``.

A null html is an empty payload, a null url is ``urn:none``; a null page_id stays null, is never
the largest unless the whole group is null, and rows that repeat the largest page_id are responses
of their own.  Payloads below ``least_bytes`` are all responses.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, Sink, discard, is_scan, located, open_fs, place_marks, placed, scratch, slices, stash

#: Fixed values of the format: the skippable frame that holds a dictionary, and a frame's magic.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary's sample: records and bytes of each at most, and the dictionary's own size.
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 256, 16_384, 32_768
_DATE = "2026-01-01T00:00:00Z"
_CHUNK = 1 << 18


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(none|-?\d+)>", urn)
    if not m:
        raise ValueError(f"bad record id {urn!r}")
    return None if m[1] == "none" else int(m[1])


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """A whole record; a revisit has no payload but the HTTP header of the one it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest32(sha1)}",
        f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, sink: Sink, level: int = 3):
        self.sink, self.level, self.first, self.packer, self.records = sink, level, [], None, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer:
            self.sink.write(self.packer.compress(data))
            return
        self.first.append(data)
        if len(self.first) >= SAMPLE:
            self._start()

    def _start(self) -> None:
        sample = [x[:SAMPLE_BYTES] for x in self.first]
        try:
            words = zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
        except zstandard.ZstdError:  # too few or too small: their own bytes serve as a raw dictionary
            words = b"".join(sample)[-DICT_BYTES:]
        known = zstandard.ZstdCompressionDict(words)
        self.sink.write(struct.pack("<II", DICT_MAGIC, len(words)) + words)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=True)
        for data in self.first:
            self.sink.write(self.packer.compress(data))
        self.first = []

    def close(self) -> int:
        if not self.packer:
            self._start()
        self.sink.close()
        return self.records


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one decoded frame at a time; memory holds one record."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("the archive is shorter than its dictionary's frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary in the leading skippable frame")
    words = stream.read(size)
    if len(words) != size:
        raise ValueError("the dictionary ends early")
    if words[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = b""
    while rest or (rest := stream.read(_CHUNK)):
        one, out = reader.decompressobj(), []
        out.append(one.decompress(rest))
        while not one.eof:
            more = stream.read(_CHUNK)
            if not more:
                raise ValueError("a frame ends early")
            out.append(one.decompress(more))
        rest = one.unused_data
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and block of one record, checked."""
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError(f"bad version line {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:40]!r}")
        key = name.decode().lower()
        if key in fields:
            raise ValueError(f"{key} twice")
        fields[key] = value.strip().decode()
    for must in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if must not in fields:
            raise ValueError(f"no {must}")
    length = fields["content-length"]
    if not length.isdigit() or int(length) != len(body) - 4 or body[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = body[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest32(hashlib.sha1(block).digest()):
        raise ValueError("the block's digest differs")
    return fields | {"block": block}


def page_row(fields: dict) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a parsed record."""
    http, gap, payload = fields["block"].partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not size:
        raise ValueError("bad HTTP header")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if int(size[1]) != len(payload) or digest32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError("the payload differs from its header")
        refers = None
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != PROFILE:
            raise ValueError("bad revisit record")
        refers, payload = _page(fields["warc-refers-to"]), None
    else:
        raise ValueError(f"unknown record type {kind}")
    return _page(fields["warc-record-id"]), int(size[1]), digest, kind, refers, fields["warc-target-uri"], payload


def write_archives(pages: DataFrame, least_bytes: int = 0) -> list[str]:
    """Write ``pages(page_id, url, html)``; the archives' places."""
    folder = scratch(pages.sparkSession, "warc")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get(), None
        uri = f"{folder}/part-{task.partitionId():06d}.warc.zst"
        for b in slices(batches, 256):
            out = out or ArchiveWriter(Sink(uri, task.taskAttemptId()))
            for row in b.to_pylist():
                out.add(record(row["page_id"], row["url"], row["payload"], row["size"], row["sha1"], row["keep_id"]))
        if out:
            yield pa.RecordBatch.from_pylist([{"uri": uri, "records": out.close()}])

    docs = pages if is_scan(pages) else stash(pages, "rows")
    rows = located(docs).select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
        FILE,
        ROW,
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    # Payloads stay where they are: digests alone are joined, and the places of revisits leave the second scan.
    prints = stash(rows.filter(F.col("size") >= least_bytes).select("page_id", "url", "sha1", "size", F.unhex(F.sha2("payload", 256)).alias("sha256"), FILE, ROW), "digests")
    groups = stash(prints.groupBy("sha256", "size").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1 and keep_id is not null").drop("n"), "payloads")
    revisits = stash(prints.join(groups, ["sha256", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("keep_id"))), "revisits")
    marks = place_marks(revisits.select(FILE, ROW))
    names = ["page_id", "url", "payload", "sha1", "size", "keep_id"]
    none = F.lit(None)
    responses = rows.filter(~placed(marks)).withColumn("keep_id", none.cast("long")).select(names)
    chosen = responses.unionByName(revisits.withColumn("payload", none.cast("binary")).select(names))
    uris = [r.uri for r in chosen.mapInArrow(write, "uri string, records long").collect()]
    discard(prints, groups, revisits)
    return uris


def read_archives(spark, uris: list[str], payloads: bool = True) -> DataFrame:
    """A row for each record; ``payload`` (null for revisits) is there if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b["uri"].to_pylist():
                fs, path = open_fs(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(page_row(parse(data)))
                        size += 200 + (len(data) if payloads else 0)
                        if size >= 1 << 23:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    listed = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)))
    return listed.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)
