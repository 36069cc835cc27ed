"""WARC archives: writing captures, reading the archives back, and assembling transactions.

Every page becomes three records: the request, the response (or a revisit of an earlier equal payload) and the
metadata. Request and metadata name the response or revisit in WARC-Concurrent-To. The archives are text files whose
record separator is the format's own (two line ends), so Spark's text writer produces them; each holds at most
RECORDS records. Reading goes by Content-Length alone, so a payload may hold anything, separators included. Records are
then joined through their concurrent-to identifiers and give one nested row for each capture.

Equal payloads are told by SHA-256 and length. Of equal payloads of at least min_bytes, the capture with the smallest
page_id (then the first in the table) is the response; null ids come last. A popular payload is one row of the
aggregate; the join that spreads it is split by Spark where it is skewed.

Nulls: a null html is an empty payload; a null url is written as an empty target; a null page_id is kept. Rows that
repeat a page_id are captures of their own (the table must be a stored one, rows are told apart by their place in it).
An empty table gives empty archives and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, numbered, shared_dir, shuffles_dropped, stash

RECORDS, ARCHIVE_BYTES = 1500, 1 << 29  # records in an archive at most, and bytes (before compression) unless one record alone has more
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target string, digest string, block_bytes long, payload_bytes long, payload_sha1 string, fields map<string,string>, payload string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 20 bits of the hex digest give four letters."""
    digest, out = F.sha1(payload), []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def record_type(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (row, page_id, url, html) with payload_bytes, payload_digest and first, the capture that it repeats or null."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("key", F.sha2(body, 256)).withColumn("payload_digest", base32_sha1(body))
    capture = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("row"))
    firsts = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("key").agg(F.min(capture).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    first = F.when((F.col("payload_bytes") >= min_bytes) & (F.col("first.row") != F.col("row")), F.struct("first.page_id", "first.row"))
    return rows.join(firsts, "key", "left").withColumn("first", first).drop("key")


def _id(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), row.cast("string")))
    parts = [F.substring(h, *p) for p in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, record_id: Column, target: Column, content: str, body: Column, *headers: tuple[str, Column]) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), target)]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value)) for name, value in headers]
    lines += [F.lit("Content-Type: " + content), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), F.lit(""), body]
    return F.concat_ws(CRLF, *lines)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """pages: page_id, url, html. Writes the archives of all pages under path."""
    rows = numbered(pages.select(F.col("page_id").cast("long"), "url", "html"), "row")
    longest = rows.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0)) + 3 * F.coalesce(F.max(F.octet_length("url")), F.lit(0)) + 2000).first()[0]
    typed = record_type(rows, min_bytes)
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    response, revisit = _id("response", F.col("row")), F.col("first").isNotNull()
    about = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), F.when(revisit, "").otherwise(F.coalesce("html", F.lit(""))))
    note = F.concat_ws(CRLF, F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.concat(F.lit("payload_bytes: "), F.col("payload_bytes").cast("string")), F.when(revisit, F.concat(F.lit("refers_to_page: "), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")))))
    records = F.array(
        _record(F.lit("request"), _id("request", F.col("row")), target, "application/http; msgtype=request", F.concat(F.lit("GET / HTTP/1.1" + CRLF + CRLF)), ("WARC-Concurrent-To", response)),
        _record(F.when(revisit, "revisit").otherwise("response"), response, target, "application/http; msgtype=response", http, ("WARC-Payload-Digest", about), ("WARC-Refers-To", F.when(revisit, _id("response", F.col("first.row")))), ("WARC-Profile", F.when(revisit, F.lit(REVISIT)))),
        _record(F.lit("metadata"), _id("metadata", F.col("row")), target, "application/warc-fields", note, ("WARC-Concurrent-To", response)),
    )
    with shuffles_dropped(rows.sparkSession):
        typed.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(3, min(RECORDS, 3 * ARCHIVE_BYTES // longest))).text(path)
    drop_stash(rows)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)", re.I | re.M)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record, by Content-Length."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        head = data[at:stop]
        size = int(_LENGTH.search(head)[1])
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record, RECORD above. payload_bytes and payload_sha1 are taken from the block that was read; payload, as text, is null unless asked for."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in RECORD.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                data = zlib.decompress(content, wbits=47) if bytes(content[:2]) == b"\x1f\x8b" else bytes(content)
                rows = []
                for h, block in parse_archive(data):
                    kind = h.get("warc-type")
                    fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x) if kind == "metadata" else {}
                    body = block.split(b"\r\n\r\n", 1)[-1] if kind == "response" else None
                    found = (None, None) if body is None else (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
                    text = body.decode("utf-8", "replace") if payloads and body is not None else None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), len(block), *found, fields, text))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata, joined through concurrent-to identifiers.

    Captures without a request or metadata keep nulls there.
    """
    captures = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("id"), F.struct("record_id", "type", "target", "digest", "refers_to", "block_bytes", "payload_bytes", "payload_sha1", "payload").alias("response"))
    others = records.filter(F.col("type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("of")).agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "target", "block_bytes"))).alias("request"),
        F.min_by(F.struct("record_id", "fields"), F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"),
    )
    return captures.join(others, captures["id"] == others["of"], "left").select(F.col("id").alias("capture_id"), "request", "response", "metadata")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back and gives one row per page.

    Size and digest are those of the payload that was read; a revisit has those of the response that it refers to. Raises
    where a digest that was read differs from the header's.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_archives(pages, path, min_bytes)
    records = stash(read_archives(spark, path, payloads=False))
    captures = assemble(records)
    referred = captures.filter("response.refers_to is not null").select(F.col("response.refers_to").alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    own = records.filter("type = 'response'").select(F.col("record_id").alias("of"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_sha1").alias("of_sha1")).join(referred, "of")
    many = F.broadcast(own.filter(F.col("n") >= max(2, -(-captures.count() // 1000))))  # 1,000 responses at most
    rows = captures.withColumn("of", F.col("response.refers_to"))
    alone = rows.filter("of is null").withColumns({"of_bytes": F.col("response.payload_bytes"), "of_sha1": F.col("response.payload_sha1")})
    again = rows.filter("of is not null")
    met = again.join(many.drop("n"), "of").unionByName(again.join(many.select("of"), "of", "left_anti").join(own.drop("n"), "of"))
    number = lambda name: F.nullif(F.col("metadata.fields")[name], F.lit("")).cast("long")
    every = alone.unionByName(met)
    digest = F.when(F.concat(F.lit("sha1:"), F.col("of_sha1")) == F.col("response.digest"), F.col("of_sha1")).otherwise(F.raise_error(F.lit("payload and digest differ")).cast("string"))
    return every.select(number("page_id").alias("page_id"), F.col("of_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.type").alias("record_type"), number("refers_to_page").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT) >> ((3 - i % 4) * 5)::INTEGER) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""
