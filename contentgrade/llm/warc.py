"""Writing pages as WARC archives and reading archives as a table of chunks.

Archives go through Spark's text source: every row it writes is raw bytes followed by a line
end, and a record is laid out so that it ends in one. So archives land on any file system
that Spark reaches, with its commit protocol, and no task writes files by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.llm.common import small_or_salted, stored

# Payloads above this are written as segments (continuation records) of this size.
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, record_type string, refers_to string, target_uri string, chunk_no int, chunk binary, "
    "bytes_so_far long, digest_so_far string, last boolean"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _quoted(url: str) -> str:
    """A url that is safe in a header line: white space and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _records(key: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, revisit: bool, date: str, segment: int) -> Iterator[bytes]:
    """A record as bytes without the line end after it, or several if the payload is cut."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{key}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _quoted(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    if len(payload) <= segment:
        yield _head([*fields, ("Content-Length", len(http) + len(payload))]) + http + payload + b"\r\n\r"
        return
    parts = range(0, len(payload), segment)
    for number, start in enumerate(parts, 1):
        block = (http if number == 1 else b"") + payload[start : start + segment]
        if number > 1:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:page:{key}:segment:{number}>"),
                ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"),
                ("WARC-Date", date),
            ]
        total = len(http) + len(payload) if number == len(parts) else None
        fields += [("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)]
        yield _head([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r"


def write_warc(
    pages: DataFrame,
    path: str,
    payload: Column | None = None,
    key: str = "page_id",
    url: str = "url",
    date: str = "1970-01-01T00:00:00Z",
    min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write a record per page, gzip-compressed archives, one per input partition.

    Of the pages of equal payloads of at least ``min_bytes`` bytes, the one of the largest
    key is a response, and the others are revisits that refer to it and hold no payload. Keys
    that repeat the largest one are responses too; null keys are smaller than all others, and
    responses if all keys of their payload are null. Payloads longer than ``segment_bytes``
    are written as segments, so no row is longer than that. A null payload is an empty one.
    Other columns are not looked at.

    The payloads that repeat, a row each, are joined to the pages: broadcast if they were
    measured to be few, else by a salted join, so a payload that a third of the pages share
    still spreads.
    """
    payload = F.coalesce(F.col("html") if payload is None else payload, F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("string").alias("_id"),
        F.col(key).alias("_key"),
        F.col(url).cast("string").alias("_url"),
        payload.alias("_payload"),
        F.sha1(payload).alias("_digest"),
    )
    repeated = (
        rows.filter(F.octet_length("_payload") >= min_bytes)
        .groupBy("_digest")
        .agg(F.max("_key").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("_digest", "_first", F.lit(True).alias("_repeated"))
    )
    met = small_or_salted(rows, stored(repeated, "warc-repeated"), "_digest").select(
        "_id",
        "_url",
        "_payload",
        "_digest",
        F.col("_first").cast("string").alias("_refers"),
        (F.coalesce("_repeated", F.lit(False)) & ~F.col("_key").eqNullSafe(F.col("_first"))).alias("_revisit"),
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for i in range(batch.num_rows):
                name, place, body, digest, refers, revisit = (c[i].as_py() for c in batch.columns)
                for record in _records(str(name or "null"), place, body, bytes.fromhex(digest), refers, revisit, date, segment_bytes):
                    out.append(record)
                    held += len(record)
                    if held > 8 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = met.mapInArrow(lines, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _ChunkReader:
    """Reads an archive piece by piece and holds no more than a chunk of it."""

    def __init__(self, chunk_bytes: int, with_payload: bool):
        self.size, self.with_payload = chunk_bytes, with_payload
        self.rows: list[tuple] = []
        self.head: dict[bytes, bytes] | None = None
        self.block_left = self.skip = 0
        self.http: bytearray | None = None

    @property
    def between(self) -> bool:
        return self.head is None and not self.block_left and not self.skip

    def feed(self, data: bytes) -> None:
        if self.skip:
            n = min(self.skip, len(data))
            self.skip -= n
            data = data[n:]
        if self.block_left:
            self._block(data[: self.block_left])
            data = data[min(self.block_left, len(data)) :] if self.block_left <= len(data) else b""
            self.block_left = self._left
            if not self.block_left:
                self._end()
                self.skip = 4 - len(data)
            return
        if data:
            self._line(data)

    def _line(self, data: bytes) -> None:
        line = data.rstrip(b"\r\n")
        if self.head is None:
            if line == b"WARC/1.1":
                self.head = {}
            elif line:
                raise ValueError(f"no record begins with {line[:40]!r}")
        elif line:
            name, _, value = line.partition(b":")
            self.head[name.strip().lower()] = value.strip()
        else:
            self._begin()

    def _begin(self) -> None:
        head = self.head
        self.block_left = int(head[b"content-length"])
        self.kind = head[b"warc-type"].decode()
        number = int(head.get(b"warc-segment-number", b"1"))
        self.final = b"warc-segment-number" not in head or b"warc-segment-total-length" in head
        if number == 1:
            self.record = head[b"warc-record-id"].decode()
            self.type = self.kind
            refers = head.get(b"warc-refers-to")
            self.refers = refers.decode() if refers else None
            uri = head.get(b"warc-target-uri")
            self.uri = uri.decode() if uri else None
            self.expected = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
            self.sha, self.count, self.number, self.buffer = hashlib.sha1(), 0, 0, bytearray()
            self.http = bytearray()
            self.declared = None
        elif head.get(b"warc-segment-origin-id", b"").decode() != self.record:
            raise ValueError(f"a segment of another record follows {self.record}")
        if not self.block_left:
            self._end()
            self.skip = 4

    def _block(self, data: bytes) -> None:
        self._left = self.block_left - len(data)
        if self.http is not None:
            self.http += data
            at = self.http.find(b"\r\n\r\n")
            if at < 0:
                return
            found = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(self.http[:at]))
            self.declared = int(found[1]) if found else None
            data, self.http = bytes(self.http[at + 4 :]), None
        while data:
            part = data[: self.size - len(self.buffer)]
            data = data[len(part) :]
            self.sha.update(part)
            self.count += len(part)
            self.buffer += part
            if len(self.buffer) >= self.size and data:
                self._emit(False)

    def _emit(self, last: bool) -> None:
        revisit = self.type == "revisit"
        digest = self.expected if revisit else base32(self.sha.digest())
        if last and not revisit and self.expected and digest != self.expected:
            raise ValueError(f"the payload of {self.record} doesn't match its digest")
        chunk = bytes(self.buffer) if self.with_payload and not revisit else None
        count = self.declared if revisit else self.count
        self.rows.append((self.record, self.type, self.refers, self.uri, self.number, chunk, count, digest, last))
        self.number += 1
        self.buffer.clear()

    def _end(self) -> None:
        if self.final:
            self._emit(True)
        self.head = None


def read_warc_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """Read archives of :func:`write_warc` as a table of payload chunks.

    A row per record and chunk number: the bytes of the chunk (null if ``with_payload`` is
    false), how many payload bytes there were up to its end, and the base32 SHA-1 digest of
    all of these. The row marked ``last`` so carries length and digest of the whole payload,
    which must equal the digest in the record's head. A revisit has one row, with the length
    and digest its head states. A task streams through an archive and holds one chunk and
    one line, and no line is longer than a segment.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))
    )
    schema = pa.schema(
        [
            ("record_id", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.string()),
            ("target_uri", pa.string()),
            ("chunk_no", pa.int32()),
            ("chunk", pa.binary()),
            ("bytes_so_far", pa.int64()),
            ("digest_so_far", pa.string()),
            ("last", pa.bool_()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = _ChunkReader(chunk_bytes, with_payload), None
        for batch in batches:
            held = 0
            for value, name in zip(batch.column(0), batch.column(1), strict=True):
                if name != file:
                    if not reader.between:
                        raise ValueError(f"{file} ends inside a record")
                    file = name
                line = value.as_py()
                reader.feed(line + b"\n")
                held += len(line)
                if reader.rows and held > 8 * chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reader.rows), schema.types)], schema=schema)
                    reader.rows, held = [], 0
            if reader.rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reader.rows), schema.types)], schema=schema)
                reader.rows = []
        if not reader.between:
            raise ValueError(f"{file} ends inside a record")

    return lines.mapInArrow(read, CHUNKS)


def page_key(record_id: Column) -> Column:
    """The key of the page that a record id names, as text; null for a page without one."""
    name = F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1)
    return F.when(name != "null", name)
