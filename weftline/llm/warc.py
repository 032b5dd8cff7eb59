"""WARC archives of web pages: written by a Spark sink, read record by record.

Each record is a gzip member of its own.  Members are gathered into archives of
about ``archive_bytes`` and stored by the text sink in Latin-1 with an empty
gzip member as line separator, so each file is an ordinary multi-member
.warc.gz on whatever file system the cluster shares, written by the executors.
The reader takes archives one at a time, inflates them in small steps, frames
records by Content-Length and checks block and payload digests.

Of pages with the same payload the one with the smallest id holds it, and the
others are revisit records that refer to it.  The shared payloads are found on
digests alone; the pages' own text is moved once, to meet its group.

Defined results: a null payload is empty; a null id is kept, and refers or is
referred to only if no other page has the payload; pages that repeat the
smallest id of a payload all hold it, as they can't be told apart; line breaks
in a URL are percent-encoded.  A wrong digest or a torn record raises ``ValueError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.scratch import Scratch

ARCHIVE_BYTES = 8 << 20
STEP = 64 << 10
_DATE = "2024-01-01T00:00:00Z"
_EMPTY = gzip.compress(b"", 6, mtime=0)


def sha1_name(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def _clean(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url or "about:blank")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = _DATE) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_name(payload)}", f"WARC-Block-Digest: sha1:{sha1_name(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


@dataclass
class Record:
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes


def _members(content: memoryview) -> Iterator[bytes]:
    """Inflate one member after the other, a step at a time."""
    at = 0
    while at < len(content):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a gzip member")
            piece = bytes(content[at : at + STEP])
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        if member := b"".join(out):
            yield member


def _headers(lines: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines.split(b"\r\n")[1:])}


def records(content: bytes | memoryview) -> Iterator[Record]:
    """Read an archive in order; each digest is checked."""
    for member in _members(memoryview(content)):
        head, found, rest = member.partition(b"\r\n\r\n")
        if not found or not head.startswith(b"WARC/"):
            raise ValueError("a gzip member doesn't start a WARC record")
        h = _headers(head)
        n = int(h["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"{h['warc-record-id']}: the record isn't as long as it says")
        if h["warc-block-digest"] != f"sha1:{sha1_name(block)}":
            raise ValueError(f"{h['warc-record-id']}: block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(_headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and (len(payload) != size or sha1_name(payload) != digest):
            raise ValueError(f"{h['warc-record-id']}: payload digest differs")
        yield Record(_page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _page(h["warc-refers-to"]) if "warc-refers-to" in h else None, size, digest, payload)


def _archives(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for rb in batches:
            for i in range(rb.num_rows):
                page, url, html, refers, revisit = (c[i].as_py() for c in rb.columns)
                out.append(record(page, url, (html or "").encode(), refers, revisit))
                size += len(out[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each page below ``path``; payloads of at least ``least_revisit`` bytes are kept once."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shared = scratch.keep(
        rows.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
        "shared",
    )
    typed = rows.join(shared, "digest", "left").select("id", "url", "html", "first", F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull()).alias("revisit"))
    typed = typed.select("id", "url", "html", F.when(F.col("revisit"), F.col("first")).alias("refers"), "revisit")
    archives = typed.mapInArrow(_archives(archive_bytes), "archive binary")
    # Latin-1 maps each byte to itself; one archive to a file.
    archives.select(F.col("archive").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for archive in rb.column(0):
                rows = []
                for r in records(archive.as_buffer()):
                    rows.append(r)
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array([getattr(x, n) for x in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([getattr(x, n) for x in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archives").path("pages")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q
    """
}
