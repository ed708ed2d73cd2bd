"""WARC output with revisit resolution.

Headers only (page id and payload digest) are shuffled by digest; of each digest the
largest page id is the original response, and the other pages of it are revisits that
refer to it. Payloads are written once a digest. Each record is a gzip member of its own.
The archives are written by Spark's text writer: a row is one record without its last
byte, and that byte is the line separator, so files commit with their tasks and a lost
executor leaves no half file. A task begins a new archive after ``ARCHIVE_BYTES``.

Record ids are made of page id and digest; rows that share both get ids of their own, and
revisits of such a response name its page and digest, but no record id. The date is that
of the run.

Archives are read back file by file and record by record, each by its Content-Length, so
payloads may hold anything, record heads included; a reader holds one archive as stored,
and one record of it.

Edge cases: a null payload is empty; digest groups count null page ids as smallest;
pages that repeat the largest id of their digest are all responses; other columns are
ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = "WARC/1.1"
CRLF, END = "\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value of the WARC specification: what a revisit record says it matches by.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task begins another archive when one has so many bytes.
ARCHIVE_BYTES = 64 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes that are inflated at a time, and records in an Arrow batch.
PIECE, BATCH = 1 << 16, 512

RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: five hex digits a time are four base32 digits."""
    quads = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("long"))
    digit = lambda v, k: F.substr(F.lit(ALPHABET), (F.shiftright(v, 15 - 5 * k) % 32 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(quads, lambda v: F.concat(*[digit(v, k) for k in range(4)])), "")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row for each digest whose payload is long enough and on more than one row: digest and the response's page id."""
    groups = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").drop("n")


def _members(gzip: bool, archive_bytes: int):  # noqa: ANN202
    """Records as gzip members (or as they are) without their last byte, and the archive of the task that each goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size = 0, 0
        for batch in common.slices(batches, BATCH):
            archives, records = [], []
            for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = (head + block + END).encode()
                if gzip:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = z.compress(record) + z.flush()
                    if record[-1]:  # the length's highest byte; an empty member ends with zeros
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        record += z.flush()
                if size and size + len(record) > archive_bytes:
                    archive, size = archive + 1, 0
                size += len(record)
                archives.append(archive)
                records.append(record[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.int32()), pa.array(records, pa.binary())], names=["archive", "record"])

    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip", date: str | None = None) -> None:
    """Write one record for each page (page_id, url, html) below ``path``."""
    when = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_of_hex(F.sha1(F.col("html").cast("binary")))})
    headers = rows.select("page_id", "payload_bytes", "payload_digest")
    twice = common.cut(headers.groupBy("page_id", "payload_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("page_id", "payload_digest", F.lit(True).alias("twice")))
    again = bool(twice.take(1))
    same = lambda a, b, to: a[to].eqNullSafe(b["page_id"]) & (a["payload_digest"] == b["payload_digest"])
    with_twice = lambda a, to: a.join(common.lookup(twice), same(a, twice, to), "left").select(*[a[c] for c in a.columns], F.coalesce("twice", F.lit(False)).alias("twice")) if again else a.withColumn("twice", F.lit(False))
    groups = common.cut(with_twice(resolve_revisits(headers, least_bytes), "refers_to").withColumnRenamed("twice", "unnamed"))
    keyed = headers.select("page_id", "payload_digest").join(common.lookup(groups), "payload_digest")
    revisits = common.cut(keyed.filter(~F.coalesce(F.col("page_id") == F.col("refers_to"), F.col("refers_to").isNull())).distinct())
    v = common.lookup(revisits).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to", "unnamed")
    rows = with_twice(rows, "page_id")
    rows = rows.join(v, rows["page_id"].eqNullSafe(v["_id"]) & (rows["payload_digest"] == v["_digest"]), "left")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    named = _uuid(F.col("page_id"), F.col("payload_digest"))
    own = _uuid(F.col("page_id"), F.col("payload_digest"), F.lit(when), F.monotonically_increasing_id())
    refers = F.when(F.col("unnamed"), F.lit("")).otherwise(line("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("payload_digest"))))
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(F.col("twice"), own).otherwise(named)),
        line("WARC-Date", F.lit(when)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), refers, line("WARC-Refers-To-Date", F.lit(when)), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    gzip = compression == "gzip"
    records = rows.select(head.alias("head"), block.alias("block")).mapInArrow(_members(gzip, archive_bytes), "archive int, record binary")
    out = records.select("archive", F.col("record").cast("string").alias("value"))
    out.write.partitionBy("archive").option("lineSep", "\x00" if gzip else "\n").option("compression", "none").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; each block is taken by its Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        start, n = end + 4, int(head["Content-Length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed")
        yield head, data[start : start + n]
        at = start + n + 4


def members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of an archive, inflated one by one; an archive that isn't compressed is one."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("the archive is cut off")
            out.append(z.decompress(data[at : at + PIECE]))
            at = min(len(data), at + PIECE)
        at -= len(z.unused_data)
        yield b"".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for member in members(memoryview(content.as_buffer())):
                for head, block in parse_warc(member):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, again = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                    if not again and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:  # noqa: S324
                        raise ValueError(f"payload of page {head['X-Page-Id']} doesn't match its digest")
                    rows.append({"page_id": head["X-Page-Id"] or None, "payload_bytes": int(head["X-Payload-Length"]) if again else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": head.get("X-Refers-To-Page-Id")})
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def read_warc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row for each record of the archives below ``path``; each response's payload is held against its digest."""
    if not common.path_exists(spark, path) or not common.list_names(spark, path, "archive="):
        return spark.createDataFrame([], RECORD.replace("page_id string", f"page_id {id_type}").replace("refers_to string", f"refers_to {id_type}"))
    files = spark.read.format("binaryFile").load(f"{path}/archive=*/part-*").select("content")
    return files.mapInArrow(_read, RECORD).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
