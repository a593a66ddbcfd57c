"""WARC archives: one gzip member per record, written and read back by Spark jobs.

Writing goes through Spark's own text writer, so any store that Spark reaches
will do. That writer ends each row with a separator of at least one byte; a
gzip member of fewer than 16 MiB ends in a zero byte (the top of its length
field), so rows are members without their last byte and the separator is that
byte. Longer payloads are cut into segments (``continuation`` records), as the
format provides.

Reading is sequential within an archive: members are inflated piece by piece,
records are framed by Content-Length, and payloads checked against their digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm.ship import ship
from recordlake.session import scratch_dir

SEGMENT = 8 << 20  # payload bytes of a record
ARCHIVE = 32 << 20  # compressed bytes after which a task begins another archive
READ = 1 << 16
ID = "urn:page:"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
          "payload binary")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def record_id(key: str | None) -> str:
    return f"<{ID}{quote(key, safe='') if key is not None else ''}>"


def page_members(key: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None,
                 date: str) -> Iterator[bytes]:
    """The records of one page: a response (in segments if it is long) or a revisit."""
    common = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if uri is not None:
        common.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        yield member([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE),
                      ("WARC-Refers-To", record_id(refers_to))], http)
        return
    parts = max(1, -(-len(payload) // SEGMENT))
    segment = [("WARC-Segment-Number", "1")] if parts > 1 else []
    yield member([("WARC-Type", "response"), *common, *segment], http + payload[:SEGMENT])
    for k in range(1, parts):
        total = [("WARC-Segment-Total-Length", str(len(http) + len(payload)))] if k == parts - 1 else []
        yield member([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{ID}{quote(key or '', safe='')}#{k}>"),
                      ("WARC-Date", date), ("WARC-Segment-Origin-ID", record_id(key)),
                      ("WARC-Segment-Number", str(k + 1)), *total], payload[k * SEGMENT:(k + 1) * SEGMENT])


def inflate(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Pieces of the records, and whether the member ends with the piece."""
    unpacker = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            data = unpacker.decompress(chunk, READ)
            if unpacker.eof:
                yield data, True
                chunk, unpacker = unpacker.unused_data, zlib.decompressobj(31)
            else:
                chunk = unpacker.unconsumed_tail
                if data:
                    yield data, False
    if unpacker.flush():
        raise ValueError("the archive ends within a record")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines if line)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, framed by Content-Length."""
    data = bytearray()
    for piece, ended in inflate(chunks):
        data += piece
        if not ended:
            continue
        at = data.index(b"\r\n\r\n")
        if not data.startswith(VERSION):
            raise ValueError("not a WARC record")
        head = fields(bytes(data[:at]))
        size = int(head["content-length"])
        if len(data) != at + 4 + size + 4 or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} has a wrong length")
        yield head, bytes(data[at + 4:at + 4 + size])
        data.clear()
    if data:
        raise ValueError("the archive ends within a record")


def page_key(text: str | None) -> str | None:
    return unquote(text[1:-1].removeprefix(ID)) or None if text else None


def pages(chunks: Iterator[bytes]) -> Iterator[tuple]:
    """Rows (id, uri, record_type, refers_to, payload_bytes, payload_digest, payload); digests are verified."""
    waiting = None
    for head, block in records(chunks):
        if head["warc-type"] == "continuation":
            if waiting is None or head["warc-segment-origin-id"] != waiting[0]["warc-record-id"]:
                raise ValueError("a segment without its record")
            waiting[1].append(block)
        else:
            if waiting:
                yield page(*waiting)
            waiting = head, [block]
    if waiting:
        yield page(*waiting)


def page(head: dict[str, str], blocks: list[bytes]) -> tuple:
    at = blocks[0].index(b"\r\n\r\n") + 4
    size = int(fields(blocks[0][:at])["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    payload = None
    if head["warc-type"] == "response":
        payload = b"".join([blocks[0][at:], *blocks[1:]])
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    uri = head.get("warc-target-uri")
    return (page_key(head["warc-record-id"]), unquote(uri) if uri is not None else None, head["warc-type"],
            page_key(head.get("warc-refers-to")), size, digest, payload)


@dataclass(frozen=True)
class _Write:
    date: str

    def __call__(self, batches):
        archive, filled, number = 0, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                key, uri, digest, refers_to, payload = (batch.column(i)[k].as_py() for i in range(5))
                made = [m[:-1] for m in page_members(key, uri, payload or b"", digest, refers_to, self.date)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(made), pa.int32()), pa.array(range(number, number + len(made)), pa.int64()),
                     pa.array(made, pa.binary())], ["archive", "number", "member"])
                number += len(made)
                filled += sum(map(len, made))
                if filled >= ARCHIVE:
                    archive, filled = archive + 1, 0


def write_archives(source: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
                   payload_col: str = "html", min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes one record per row below ``path``; returns ``path``.

    Among rows with equal payloads of at least ``min_revisit`` bytes the one
    with the smallest id is the response, and the others revisit it. Null
    payloads count as empty. Rows with a null id are never referred to; rows
    that repeat an id are written as often as they occur. Other columns are
    not read. The duplicates' digests are a table in the shared folder, joined
    back as two plain inputs, so that one hot payload can be split over tasks.
    """
    spark = ship(source.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    long_enough = F.octet_length(payload) >= min_revisit
    again = f"{scratch_dir(spark, 'warc')}/repeated"
    (source.where(long_enough).select(digest.alias("digest"), F.col(id_col).alias("key"))
     .groupBy("digest").agg(F.min("key").alias("leader"), F.count("*").alias("n"))
     .where("n > 1 and leader is not null").select("digest", "leader").write.parquet(again))
    leaders = spark.read.parquet(again)
    rows = source.select(F.col(id_col).alias("key"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"),
                         digest.alias("digest"))
    joined = rows.join(leaders, "digest", "left").select(
        F.col("key").cast("string"), "uri", "digest",
        F.when(~F.col("key").eqNullSafe(F.col("leader")), F.col("leader")).cast("string").alias("refers_to"), "payload")
    # A record's segments must stay behind it: the writer sorts by archive, and a sort that spills keeps no order
    # of equal keys, so the running number is part of the order.
    (joined.mapInArrow(_Write(date), "archive int, number long, member binary").sortWithinPartitions("archive", "number")
     .select("archive", F.col("member").cast("string").alias("value"))
     .write.partitionBy("archive").option("lineSep", "\x00").option("compression", "none").text(path))
    return path


@dataclass(frozen=True)
class _Read:
    payloads: bool

    def __call__(self, batches):
        schema = pa.schema([("id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                out, held = [], 0
                for row in pages(bytes(view[a:a + READ]) for a in range(0, len(view), READ)):
                    out.append(row if self.payloads else (*row[:-1], None))
                    held += len(row[-1] or b"") if self.payloads else 100
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page of the archives below ``path``: id, uri, record_type, refers_to,
    payload_bytes, payload_digest, payload (null for revisits, or if not wanted).

    A damaged record (length, digest, order of segments) raises an error. A
    folder without archives gives no rows.
    """
    ship(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .where("length > 0").select("content"))
    return files.mapInArrow(_Read(payloads), SCHEMA)
