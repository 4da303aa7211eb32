"""Web archives in WARC 1.0 with revisit records for payloads that are already there.

Writing: digests and sizes of all payloads form a table of headers. It is shuffled by digest to find each payload's original,
the record of largest page_id, and the others are joined to it and become revisits. Only then are the payloads themselves moved,
once, to the files in which they are written, with headers made anew. All of this is Spark's own expressions; Python only parses
archives when they are read.

* Files hold about FILE_BYTES of payloads each, so reading one takes bounded memory. They are gzip files of whole records.
* A payload that a third of all pages share is one hot digest among the headers: its original comes from an aggregate that
  combines before the shuffle, and adaptive execution splits the join with it, since both sides are stored tables.
* Payloads below `least` bytes are written in full each time.

A null payload is an empty one. A page without an id is older than all others and gets no id when read. Rows that repeat page_id and
payload are written alike. Without pages there are no records. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import tables

FILE_BYTES = 16_000_000
FIRST = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_END = "\r\n"
_READ = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32, from five hexadecimal digits to four of base 32 at a time."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    # fixed values: digits of conv() and of RFC 4648 base 32
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(page: Column, archive: str) -> Column:
    """Record id: the archive's own name and the page's id."""
    return F.concat(F.lit(f"<urn:page:{archive}:"), F.when(page == FIRST, F.lit("none")).otherwise(page.cast("string")), F.lit(">"))


def resolved(pages: DataFrame, least: int) -> DataFrame:
    """page, digest, original (null for responses) and the original's address of every distinct record."""
    headers = pages.select("page", "digest", "size", "url")
    newest = headers.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page", "url")).alias("newest"))
    originals = tables.stored(newest.select("digest", F.col("newest.page").alias("original"), F.col("newest.url").alias("original_url")))
    joined = headers.join(originals, "digest", "left")
    revisit = F.col("original") != F.col("page")
    return joined.select("page", "digest", F.when(revisit, F.col("original")).alias("original"), F.when(revisit, F.col("original_url")).alias("original_url")).distinct()


def _target(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20]+", "%20")


def _record(archive: str, date: str) -> Column:
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"), F.lit(_END + _END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _name(F.col("page"), archive)),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _target(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _name(F.col("original"), archive))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, _target(F.col("original_url")))),
        ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    # the writer ends each row with a line feed, the last byte of a record
    return F.concat(F.lit(f"WARC/1.0{_END}"), F.concat_ws(_END, *lines), F.lit(_END + _END), block, F.lit(f"{_END}\r"))


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Writes one record for each page into gzip files of the folder. All records bear the time of writing, in UTC, and ids that no other archive has."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(FIRST)).alias("page"), F.col("url").cast("string"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    total = keyed.select(F.sum("size")).first()[0] or 0
    files = max(1, total // FILE_BYTES, tables.shuffle_partitions(pages.sparkSession) if total > FILE_BYTES else 1)
    placed = keyed.repartition(int(files), "page", "digest")
    records = placed.join(resolved(keyed, least), ["page", "digest"]).select(_record(uuid.uuid4().hex, date).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        stream.read(4)
        _, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "revisit":
            yield _page(fields["warc-record-id"]), "revisit", digest, None, _page(fields["warc-refers-to"]), None
        else:
            yield _page(fields["warc-record-id"]), "response", digest, len(payload), None, base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest


def _page(name: str) -> int | None:
    code = name.strip("<>").rpartition(":")[2]
    return None if code == "none" else int(code)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, payload_digest, payload_bytes, refers_to and intact (whether the payload has its digest) of every record. Revisits take size and state from the response that they refer to."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(_parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], _READ.replace(",", "").split()[::2])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    found = tables.stored(files.mapInArrow(records, _READ))
    responses = tables.stored(found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"), F.min("intact").alias("whole")))
    revisits = found.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    return found.where("record_type = 'response'").unionByName(revisits.withColumns({"payload_bytes": F.col("size"), "intact": F.col("whole")}).select(*found.columns))


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives into a folder of their own and returns what is read back."""
    folder = tables.new_folder(pages.sparkSession)
    write(pages, folder, least)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


#: The rows that reading gives back, made from the pages alone. Base 32 goes by five hexadecimal digits, as above.
ORACLE = """
WITH payloads AS (SELECT page_id, sha1(coalesce(html, '')) AS code, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
named AS (SELECT page_id, payload_bytes, list_aggregate(list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(code, i, 5))::BIGINT >> j) & 31) + 1)::BIGINT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM payloads),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to, true AS intact
FROM newest
"""
