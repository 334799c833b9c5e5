"""WARC archives: writing, reading, and resolving records with equal payloads into revisits.

An archive is a file of gzip members, one a record, padded with one zero byte at its end, which gzip
readers skip. A record is ``WARC/1.1`` with an HTTP response as its block. Archives are cut at
``ARCHIVE_BYTES`` of records before compression, so that one task can hold one; a record of more is an
archive of its own (a string of Spark has 2 GB at most, and a file that Spark reads whole as well, so a
page may have some 1 GB). A record's date is that of a column, if one is named, else the one given.

Resolution: the headers of all records (no payloads) are shuffled by payload digest; of equal digests
and lengths of at least ``min_bytes`` the record with the largest row identifier (null last, then the
largest record identifier) is the response that stays; every other one is joined to it and becomes a
revisit with the profile ``identical-payload-digest``, whose block has the HTTP header only. The
decisions go back to their archives and new archives are written with fresh headers: new length and
type, the digest kept, and for revisits ``WARC-Refers-To`` with the response's identifier, address and
date. Reading back joins revisits to responses by record identifier.

A null page is an empty payload; a null address is written as ``urn:none``; control characters and
spaces in addresses are percent-encoded. Repeated rows are records of their own. Equal payloads below
``min_bytes`` all stay responses. Empty tables give no archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs_in, blobs_out, cut, remove, ship, text_of, work_dir

ARCHIVE_BYTES = 16_000_000
#: Revisits up to which their list goes to the archives; beyond, archives are shuffled to their lists.
MAX_BROADCAST = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HEADERS = "path string, number long, record_id string, row_id long, url string, date string, digest string, payload_bytes long"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, date: str, url: str, row_id: int | None, digest: str, payload: bytes, payload_bytes: int, more: dict[str, str] | None = None) -> bytes:
    """One record as it stands in an archive before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        **({} if row_id is None else {"X-Row-ID": str(row_id)}),
        **(more or {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one by one."""
    view = memoryview(data)
    at = 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        z = zlib.decompressobj(31)
        parts, take = [], 65_536
        while not z.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            piece = view[at : at + take]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("this is not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def _payload_bytes(http: bytes) -> int:
    return int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", date_col: str | None = None, level: int = 3) -> str:
    """Write a response record per row; the folder's path is returned.

    ``date_col`` names a column of time stamps; a null one has the date given as ``date``.
    """
    spark = pages.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for row_id, url, html, when in zip(*(c.to_pylist() for c in b.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                record_id = uuid.uuid5(_SPACE, f"{part}/{n}/{row_id}").urn
                data = record("response", record_id, when, _address(url), row_id, digest_of(payload), payload, len(payload))
                held.append(member(data, level))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])

    when = F.lit(date) if date_col is None else F.coalesce(F.date_format(F.to_utc_timestamp(F.col(date_col), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date))
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"), when.alias("date"))
    return blobs_out(rows.mapInArrow(run, "blob binary"), "blob", path or work_dir(spark, "warc"), "\0")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per response record: where it is, who it is, and its payload's digest and length."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for n, one in enumerate(members(data)):
                    f, http, _ = parse(one)
                    row = f.get("X-Row-ID")
                    out.append((file, n, f["WARC-Record-ID"].strip("<>"), None if row is None else int(row), f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Payload-Digest"].removeprefix("sha1:"), _payload_bytes(http)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = [x.split()[0] for x in _HEADERS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in _HEADERS.split(", ")]
    return blobs_in(spark, path).mapInArrow(run, _HEADERS)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with ``target``: the response that a record revisits (null: it is one itself)."""
    who = F.struct(F.col("row_id").isNotNull().alias("has"), "row_id", "record_id", "url", "date")
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    kept = large.groupBy("digest", "payload_bytes").agg(F.max(who).alias("target"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("payload_bytes").alias("l"), "target")
    same = (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("l"))
    out = headers.join(kept, same, "left")
    return out.select(*headers.columns, F.when(F.col("target.record_id") != F.col("record_id"), F.col("target")).alias("target"))


def write_resolved(spark: SparkSession, source: str, resolved: DataFrame, path: str | None = None, level: int = 6) -> str:
    """New archives: the records of ``source`` with revisits where ``resolved`` says so."""
    ship(spark)
    targets = cut(resolved.where("target is not null").select("path", "number", "target.record_id", "target.row_id", "target.url", "target.date"), "warc-targets")
    # An archive has a bounded number of records, so its list is bounded too.
    wanted = targets.groupBy("path").agg(F.collect_list(F.struct("number", "record_id", "row_id", "url", "date")).alias("revisits"))
    wanted = F.broadcast(wanted) if targets.count() <= MAX_BROADCAST else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, revisits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to = {r["number"]: r for r in revisits or ()}
                out = []
                for n, one in enumerate(members(data)):
                    f, http, payload = parse(one)
                    row = f.get("X-Row-ID")
                    args = (f["WARC-Record-ID"].strip("<>"), f["WARC-Date"], f["WARC-Target-URI"], None if row is None else int(row), f["WARC-Payload-Digest"].removeprefix("sha1:"))
                    if t := to.get(n):
                        more = {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{t['record_id']}>", "WARC-Refers-To-Target-URI": t["url"], "WARC-Refers-To-Date": t["date"]}
                        out.append(member(record("revisit", *args, b"", _payload_bytes(http), more), level))
                    else:
                        out.append(member(record("response", *args, payload, len(payload)), level))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["blob"])

    rows = blobs_in(spark, source).join(wanted, "path", "left").select("content", "revisits")
    return blobs_out(rows.mapInArrow(run, "blob binary"), "blob", path or work_dir(spark, "warc-resolved"), "\0")


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of resolved archives; digests of responses are checked against payloads."""
    ship(spark)
    schema = "record_id string, row_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to_id string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                out = []
                for one in members(data):
                    f, http, payload = parse(one)
                    row, digest, kind, size = f.get("X-Row-ID"), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], _payload_bytes(http)
                    if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                        raise ValueError(f"the payload of {f['WARC-Record-ID']} isn't what its header says")
                    to = f.get("WARC-Refers-To")
                    one_row = (f["WARC-Record-ID"].strip("<>"), None if row is None else int(row), f["WARC-Target-URI"], kind, digest, size, to and to.strip("<>"))
                    out.append(one_row + (payload,) * payloads)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return blobs_in(spark, path).select("content").mapInArrow(run, schema)


def resolve_refers(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the row identifier of the response that a revisit names."""
    to = records.where("record_type = 'response'").select(F.col("record_id").alias("to_id"), F.col("row_id").alias("refers_to"))
    # One hot response may have a third of all revisits: a skewed join that Spark splits at run time.
    return records.join(to, F.col("refers_to_id") == F.col("to_id"), "left").drop("to_id")


def dedup_archives(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Write archives of ``pages``, resolve them, and return the records of the new archives."""
    spark = pages.sparkSession
    first = write_archives(pages, **columns)
    headers = cut(read_headers(spark, first), "warc-headers")
    second = write_resolved(spark, first, resolve(headers, min_bytes))
    remove(first)
    records = cut(read_records(spark, second), "warc-records")
    remove(second)
    remove(headers)
    return resolve_refers(records)
