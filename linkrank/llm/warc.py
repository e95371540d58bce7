"""WARC archives: written and read back by Spark, captures assembled from their records."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, rows_of, saved, scratch_dir

CRLF = "\r\n"
NEXT = "\r\n\r\nWARC/1.1\r\n"  # what most records begin after; where a payload has it too, the lengths tell
SALTS = 16
IN_BROADCAST = 500_000  # digests of copies; more are joined by shuffle
FILE_BYTES = 64 << 20  # of payloads in an archive file, about
DATE = "2024-01-01T00:00:00Z"
RECORD = pa.schema(
    [
        ("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)
RECORD_DDL = "record_type string, record_id string, concurrent_to string, target_uri string, payload_bytes long, payload_digest string, page_id long, refers_to long, payload binary"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time are 10 hex digits and 8 base32 digits."""
    digest = F.sha1(text)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for i in range(4)))


def _record(kind: Column, record_id: Column, extra: Column, mime: str, block: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"), extra,
        F.lit(f"Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages(page_id, url, html).

    Of rows whose payloads are equal and at least min_revisit_bytes long, that with the largest page_id is the
    response; the others become revisits, whose payload is not stored again. A null html is an empty payload, a null url an
    empty target; null page_ids count as smallest, and repeated rows with the winning page_id are each a response.
    The files are gzip streams of whole records, of about file_bytes each by the mean payload; a payload's size is limited only by a string's."""
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", "")
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    rows = pages.select(F.col("page_id").cast("long"), clean.alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html"))
    best = F.max(F.struct("page_id", "url"))
    first = saved(rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("digest").alias("d"), "best"))
    if first.count() <= IN_BROADCAST:
        rows = rows.join(F.broadcast(first), F.col("digest") == F.col("d"), "left")
    else:  # each digest once for every salt, so that the rows of a very common page are dealt out
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("s", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).join(salted, (F.col("digest") == F.col("d")) & (F.col("s") == F.col("salt")), "left")
    again = (F.col("n") >= min_revisit_bytes) & F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    ident = lambda kind: F.regexp_replace(F.md5(F.concat_ws("|", F.lit(kind), "at", "digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit(CRLF))
    near = F.concat(uri, F.lit("WARC-Concurrent-To: "), ident("response"), F.lit(CRLF))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    known = F.concat(uri, F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF))
    profile = F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To-Target-URI: "), F.coalesce(F.col("best.url"), F.lit("")), F.lit(f"{CRLF}WARC-Refers-To-Date: {DATE}{CRLF}"))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}User-Agent: linkrank{CRLF}{CRLF}"))
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}refersToPage: "), F.coalesce(F.when(F.col("again"), F.col("best.page_id")).cast("string"), F.lit("")), F.lit(CRLF))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))
    records = F.array(
        _record(F.lit("request"), ident("request"), near, "application/http; msgtype=request", get),
        F.when(F.col("again"), _record(F.lit("revisit"), ident("response"), F.concat(known, profile), "application/http; msgtype=response", head)).otherwise(
            _record(F.lit("response"), ident("response"), known, "application/http; msgtype=response", F.concat(head, F.col("html")))
        ),
        _record(F.lit("metadata"), ident("metadata"), near, "application/warc-fields", fields),
    )
    out = rows.select(F.explode(records).alias("value")).write
    out.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, int(file_bytes // (mean + 1000)))).text(path)


class Archive:
    """The records of one archive from its bytes, which come piece by piece; no more is held than the record at hand."""

    def __init__(self, name: str, with_payload: bool = True):
        self.name, self.with_payload, self.held, self.wanted = name, with_payload, bytearray(), 0

    def feed(self, data: bytes):
        """Rows of RECORD that are now whole. A response whose payload doesn't have the digest in its header is an error."""
        self.held += data
        while len(self.held) > self.wanted:
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.held[:end].decode().split(CRLF)
            if not lines[0].startswith("WARC/1."):
                raise ValueError(f"{self.name}: no record where one should begin")
            head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            size = int(head["content-length"])
            self.wanted = end + 8 + size
            if len(self.held) < self.wanted:
                self.wanted -= 1
                return
            block = bytes(self.held[end + 4 : end + 4 + size])
            if self.held[end + 4 + size : self.wanted] != b"\r\n\r\n":
                raise ValueError(f"{self.name}: {head['warc-record-id']} doesn't end where its length says")
            del self.held[: self.wanted]
            self.wanted = 0
            yield self._row(head, block)

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{self.name}: its last record is cut short")

    def _row(self, head: dict, block: bytes) -> tuple:
        kind, n, digest, page, refers, payload = head["warc-type"], None, None, None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            http = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in http.decode().split(CRLF)[1:])}
            n, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                n = len(payload)
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{self.name}: payload of {head['warc-record-id']} doesn't have its digest")
            else:
                payload = None
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
            page, refers = (int(v) if (v := fields.get(k)) else None for k in ("pageId", "refersToPage"))
        return kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), n, digest, page, refers, payload if self.with_payload else None


def parse_archive(data: bytes, with_payload: bool = True):
    """Rows of RECORD of one whole archive; gzip streams, of one or many members, or plain."""
    archive = Archive("archive", with_payload)
    yield from archive.feed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    archive.close()


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of gzip archives (.gz, which Spark doesn't split). Spark reads and unpacks them in pieces that end where records mostly do;
    a task holds a batch of pieces and one record."""

    def parse(batches):
        out, archive = Rows(RECORD), None
        for name, piece in rows_of(batches, "name", "piece"):
            if archive is None or archive.name != name:
                if archive:
                    archive.close()
                archive = Archive(name, with_payload)
            else:
                piece = NEXT.encode() + piece
            for row in archive.feed(piece):
                if out.add(*row, weight=400 + len(row[-1] or b"")):
                    yield out.take()
        if archive:
            archive.close()
        yield out.take()

    pieces = spark.read.option("lineSep", NEXT).text(path).select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(parse, RECORD_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata meet by the id that the two others
    name as concurrent. A capture without a request or metadata record has null there."""
    here = F.coalesce("concurrent_to", "record_id")
    whole = F.struct("record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "payload")
    pick = lambda kinds, what, name: F.first(F.when(F.col("record_type").isin(kinds), what), ignorenulls=True).alias(name)
    return records.groupBy(here.alias("capture_id")).agg(
        pick(["request"], F.struct("record_id", "target_uri"), "request"),
        pick(["response", "revisit"], whole, "response"),
        pick(["metadata"], F.struct("record_id", "page_id", "refers_to"), "metadata"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    c = captures(read_records(spark, path, with_payload=False))
    return c.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("metadata.refers_to").alias("refers_to"),
    )


OP10_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
s as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha1(html) hex,
      max(page_id) over (partition by html) best from p),
b as (select *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int, 1)) ds from s)
select page_id, payload_bytes, array_to_string(ds, '') payload_digest,
  case when page_id = best then 'response' else 'revisit' end record_type,
  case when page_id = best then null else best end refers_to from b
"""
