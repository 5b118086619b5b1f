"""WARC: archives of request, response and metadata records, and one nested row per capture."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

#: Payloads of at least so many bytes may be stored once and revisited.
REVISIT_FROM = 0
#: Records of one archive file at most, so that a reader's memory stays bounded.
FILE_RECORDS = 1500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "capture string, record_id string, kind string, page_id long, uri string, copies long, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary"


def base32(hex40: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 as 32 upper-case base32 digits: 20 bits make four digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _ident(page: Column, digest: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(f":{kind}>"))


def _record(kind: Column | str, ident: Column, uri: Column, more: list[Column], body: Column) -> Column:
    """A record without its last newline, which the text writer adds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), *more, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, least: int = REVISIT_FROM, file_records: int = FILE_RECORDS) -> None:
    """Writes pages (page_id, url, html) as gzipped archive files under path: three records for each capture.

    Of equal payloads of at least `least` bytes, the smallest page_id is stored as a response and the others
    as revisits of it. A null html is an empty payload, a null url an empty target. Rows equal in page_id and
    payload are one capture whose metadata counts them; a null page_id comes after all others.
    """
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("uri"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32(F.sha1(F.col("html").cast("binary"))))
    slim = written(rows.groupBy("digest", "page_id").agg(F.count("*").alias("copies"), F.min("uri").alias("uri"), F.min(F.octet_length("html")).alias("n")), "warc-captures")
    # Both sides of the joins are tables, so that a digest or a target of very many pages can be split over tasks.
    first = written(slim.groupBy("digest").agg(F.min("page_id").alias("first")), "warc-first")
    known = slim.join(first, "digest").withColumn("revisit", (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    known = written(known, "warc-known")
    answer, page, digest = _ident(F.col("page_id"), F.col("digest"), "response"), F.col("page_id"), F.col("digest")
    tied = F.concat(F.lit("WARC-Concurrent-To: "), answer)
    sent = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.regexp_extract("uri", r"^[a-z]+://([^/]*)", 1), F.lit("\r\n\r\n"))
    notes = F.concat(F.lit("page: "), F.coalesce(page.cast("string"), F.lit("null")), F.lit("\r\ncopies: "), F.col("copies").cast("string"), F.lit("\r\n"))
    side = [_record("request", _ident(page, digest, "request"), F.col("uri"), [tied, F.lit("Content-Type: application/http; msgtype=request")], sent), _record("metadata", _ident(page, digest, "metadata"), F.col("uri"), [tied, F.lit("Content-Type: application/warc-fields")], notes)]
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    full = _record("response", answer, F.col("uri"), [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)], F.concat(status, F.col("html")))
    back = [F.concat(F.lit("WARC-Refers-To: "), _ident(F.col("first"), digest, "response")), F.lit(f"WARC-Profile: {PROFILE}"), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)]
    again = _record("revisit", answer, F.col("uri"), back, status)
    small = known.select(F.explode(F.concat(F.array(*side), F.when(F.col("revisit"), F.array(again)).otherwise(F.array().cast("array<string>")))).alias("value"))
    # Only responses need their payload, so revisits of a much repeated page move no text.
    stored = known.where(~F.col("revisit")).select("page_id", "digest", F.col("uri").alias("u"))
    whole = rows.withColumnRenamed("uri", "own").join(stored, rows["page_id"].eqNullSafe(stored["page_id"]) & (rows["digest"] == stored["digest"])).select(rows["page_id"], rows["digest"], F.col("u").alias("uri"), "html")
    whole = whole.dropDuplicates(["page_id", "digest"]) if known.where("copies > 1").limit(1).count() else whole
    whole = whole.select(full.alias("value"))
    for part, name in ((small, "side"), (whole, "responses")):
        part.write.option("maxRecordsPerFile", file_records).option("compression", "gzip").text(f"{path}/{name}")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, body) of the records of an archive; raises ValueError where it is damaged."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield head, data[start:stop]
        at = stop + 4


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archive files under path; payload is null unless payloads are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, body in parse(gzip.decompress(data.as_py())):
                    kind, page, copies = head.get("warc-type"), None, None
                    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if kind == "metadata":
                        told = dict(line.split(": ", 1) for line in body.decode().split("\r\n") if line)
                        page, copies = None if told["page"] == "null" else int(told["page"]), int(told["copies"])
                    rows.append((head.get("warc-concurrent-to") or head["warc-record-id"], head["warc-record-id"], kind, page, head.get("warc-target-uri"), copies, head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if payload is None else len(payload), None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if payloads else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: the records that name the same record as concurrent, with that record.

    Columns: capture, request, answer (a response or a revisit) and metadata, each a struct or null where the
    archive has no such record. Grouping by the identifier is the join of the record kinds.
    """
    of = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), F.struct("record_id", "kind", "page_id", "uri", "copies", "refers_to", "digest", "payload_bytes", "payload_digest", "payload")), ignorenulls=True)
    return found.groupBy("capture").agg(of("request").alias("request"), of("response", "revisit").alias("answer"), of("metadata").alias("metadata"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    rows = captures(records(spark, path)).select(F.col("metadata.page_id").alias("page_id"), F.col("metadata.copies").alias("copies"), F.col("capture"), "answer.payload_bytes", "answer.payload_digest", F.col("answer.kind").alias("record_type"), F.col("answer.refers_to").alias("target"))
    rows = written(rows, "warc-rows")
    # rows is a table, so a response with very many revisits can be split too.
    stored = rows.where("record_type = 'response'").select(F.col("capture").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    out = rows.join(stored, "target", "left").select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", "refers_to", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.drop("copy")


#: base32 is built from the hexadecimal digest, five digits (20 bits) at a time.
SQL = """
WITH hashed AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
rows AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM rows JOIN firsts USING (payload_digest)
"""
