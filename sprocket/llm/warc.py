"""WARC records as a chunked record table (operator 2).

An archive is a table of chunks (record, chunk, data, digest): the data of a record's
chunks in order are the bytes of a WARC/1.1 record, and digest is the SHA-1 of the
payload up to and including the chunk. The writer walks a record's bytes by views into
the Arrow buffer, so no record is copied whole; the reader keeps a record's running
digest and counts between chunks, checks every chunk's digest on the way, and never puts
a record together. Records of one chunk are read where they lie; only chunks of longer
records are brought together, sorted by record and chunk.

Of records with equal payloads of at least min_bytes, the one with the smallest key is
the response and the others are revisits that refer to it and carry no payload.

Defined cases: a null payload is empty; a null url writes no WARC-Target-URI; rows that
share the smallest key of a payload are all responses; a null key is never the smallest,
and is a response only if no row of the payload has a key; repeated rows are records of
their own, which share the name of their page; an empty table gives an empty archive;
other columns are not carried, so none can clash but those that start with ``_warc_``.
A damaged, missing or misplaced chunk makes its record invalid and no other.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CHUNK_BYTES = 32 * 1024
#: Bytes of chunks in a batch, about.
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: what ends a WARC record.
END = b"\r\n\r\n"
CHUNKS = "record long, key long, chunk int, last boolean, data binary, digest binary"
RECORDS = "key long, record_type string, payload_bytes long, payload_digest string, refers_to long, valid boolean"


def decided(df: DataFrame, payload: str = "html", key: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """df with _warc_refers, null for responses. Digests are compared, not payloads; keys are aggregated before they are joined."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.withColumn("_warc_sha1", F.when(F.octet_length(body) >= min_bytes, F.sha1(body)))
    first = rows.filter("_warc_sha1 is not null").groupBy("_warc_sha1").agg(F.min(key).alias("_warc_first"), F.count("*").alias("_warc_n")).filter("_warc_n > 1").drop("_warc_n")
    x = rows.join(first, "_warc_sha1", "left")
    return x.withColumn("_warc_refers", F.when(F.col(key).eqNullSafe(F.col("_warc_first")), F.lit(None)).otherwise(F.col("_warc_first")).cast("long")).drop("_warc_first", "_warc_sha1")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def uri(url: str) -> str:
    """The url without what could break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(record: int, key: int | None) -> str:
    """A record is named by its page, which a revisit of it knows, too; one without a key by its number."""
    return f"urn:sprocket:page:{key}" if key is not None else f"urn:sprocket:record:{record}"


def head(record: int, key: int | None, url: str | None, refers: int | None, size: int, digest: str) -> bytes:
    """The header block, and for responses the HTTP header that precedes the payload."""
    http = b"" if refers is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{record_id(record, key)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(record, refers)}>"]
    if key is not None:
        lines.append(f"X-Page: {key}")
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if refers is not None else size)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _views(column: pa.Array) -> Iterator[memoryview]:
    """Each value's bytes, without a copy; null is empty."""
    for x in column:
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def write_chunks(df: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of the archive of a decided table."""
    src = df.select(F.monotonically_increasing_id().alias("record"), F.col(key).cast("long"), F.col(url).cast("string"), F.col("_warc_refers"), F.col(payload).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(4)]
            for record, k, u, refers, body in zip(*columns, _views(b.column(4)), strict=True):
                total = hashlib.sha1()
                for at in range(0, len(body), chunk_bytes):
                    total.update(body[at : at + chunk_bytes])
                start = head(record, k, u, refers, len(body), base32(total.digest()))
                parts = range(0, len(body), chunk_bytes) if refers is None and len(body) else (0,)
                so_far = hashlib.sha1()
                for i, at in enumerate(parts):
                    view = body[at : at + chunk_bytes] if refers is None else body[:0]
                    so_far.update(view)
                    last = i == len(parts) - 1
                    rows.append((record, k, i, last, (start if i == 0 else b"") + bytes(view) + (END if last else b""), (so_far if refers is None else total).digest()))
                    size += len(view)
                    if size >= BATCH_BYTES or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return src.mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record", "key", "chunk", "last", "data", "digest"])


class Reading:
    """A record that is being read, chunk by chunk."""

    def __init__(self, data: memoryview) -> None:
        whole = bytes(data[:4096]) if len(data) > 4096 else bytes(data)
        end = whole.find(b"\r\n\r\n")
        if end < 0:
            whole = bytes(data)
            end = whole.index(b"\r\n\r\n")
        first, *lines = whole[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.headers = dict(x.split(": ", 1) for x in lines)
        self.skip = end + 4
        self.left = int(self.headers["Content-Length"])
        if self.headers["WARC-Type"] == "response":
            http = whole.find(b"\r\n\r\n", self.skip)
            http = bytes(data).index(b"\r\n\r\n", self.skip) if http < 0 else http
            self.left -= http + 4 - self.skip
            self.skip = http + 4
        self.sha1, self.size, self.valid, self.next, self.whole = hashlib.sha1(), 0, True, 0, False

    def add(self, chunk: int, last: bool, data: memoryview, digest: bytes) -> None:
        body = data[self.skip : self.skip + self.left]
        self.skip = 0
        self.left -= len(body)
        self.size += len(body)
        self.sha1.update(body)
        revisit = self.headers["WARC-Type"] == "revisit"
        self.valid = self.valid and chunk == self.next and not self.whole and (revisit or self.sha1.digest() == digest)
        self.next, self.whole = chunk + 1, last

    def row(self) -> tuple:
        h = self.headers
        revisit = h["WARC-Type"] == "revisit"
        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(h["X-Payload-Length"])
        valid = self.valid and self.whole and self.left == 0 and (revisit or (self.size == size and base32(self.sha1.digest()) == said))
        refers = int(h["WARC-Refers-To"].strip("<>").rpartition(":")[2]) if revisit else None
        return int(h["X-Page"]) if "X-Page" in h else None, h["WARC-Type"], size if revisit else self.size, said if revisit else base32(self.sha1.digest()), refers, valid


def read_chunks(chunks: DataFrame) -> DataFrame:
    """A row for each record of an archive, from its bytes. valid: all chunks are there in order, and all digests and lengths agree; of a record without a readable first chunk only the key is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reading | None = None
        of: tuple[int, int | None] | None = None

        def ended() -> tuple:
            return now.row() if now else (of[1], None, None, None, None, False)

        for b in batches:
            out = []
            for record, key, chunk, last, data, digest in zip(*(b.column(k).to_pylist() for k in range(4)), _views(b.column(4)), b.column(5).to_pylist(), strict=True):
                if of is None or of[0] != record:
                    if of is not None:
                        out.append(ended())
                    of = record, key
                    try:
                        now = Reading(data) if chunk == 0 else None
                    except (ValueError, KeyError):
                        now = None
                if now:
                    now.add(chunk, last, data, digest)
            yield made(out)
        if of is not None:
            yield made([ended()])

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        cols = zip(*out, strict=True) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "record_type", "payload_bytes", "payload_digest", "refers_to", "valid"])

    rows = chunks.select("record", "key", "chunk", "last", "data", "digest")
    alone = rows.filter("chunk = 0 and last").mapInArrow(run, RECORDS)
    longer = rows.filter("not (chunk = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(run, RECORDS)
    return alone.unionByName(longer)


def write_archive(df: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, path: str | None = None) -> DataFrame:
    """Writes the archive of df (to path, or to the shared folder) and returns its chunk table."""
    chunks = write_chunks(decided(df, payload, key, min_bytes), payload, key, url, chunk_bytes)
    if path is None:
        return written(chunks, "warc")
    chunks.write.option("compression", "zstd").parquet(path)
    return read_table(df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)
