"""Web archives: writing segmented records with chunked payloads, and putting them together again.

Records are written by Spark's text writer, one a value, so every byte of a file is a record's or the
blank lines between two.  They are read by Spark's text reader with the start of a record as the line
separator: files are split or streamed, and no task holds more than a record, which segmentation keeps
small.  The separator is the version line alone, without the blank lines before it: the reader misses a
separator whose beginning repeats at the edge of its buffer, and nothing in this line repeats.
Columns hold bytes as strings that nobody decodes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: Bytes of a chunk, and of a record's block before it goes on in a continuation record.
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16384
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
             f"Transfer-Encoding: chunked{CRLF}{CRLF}")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (bytes as string), payload_bytes and payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"))


def with_revisits(facts: DataFrame) -> DataFrame:
    """``facts`` with refers_to: the largest page_id that has the payload, where that is another's
    and the payload is large enough.

    Largest ids are taken per digest before the shuffle, one row a digest is joined back, so
    adaptive skew splitting deals out a payload that many pages share.
    """
    large = F.col("payload_bytes") >= LEAST_REVISIT
    largest = (facts.where(large).groupBy("payload_digest")
               .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("pages"))
               .where("pages > 1").select(F.col("payload_digest").alias("_digest"), "largest"))
    other = large & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return (facts.join(largest, F.col("payload_digest") == F.col("_digest"), "left")
            .withColumn("refers_to", F.when(other, F.col("largest")))
            .drop("_digest", "largest"))


def _bytes(text: Column, start: Column | int, length: Column | int) -> Column:
    """Part of a string by bytes, from 1."""
    return F.substring(text.cast("binary"), start, length).cast("string")


def chunked(payload: Column, size: int) -> Column:
    """Chunked transfer framing.  A chunk also ends inside each version line that a payload quotes,
    so that no block holds the line which starts a record."""
    quoted = F.split(payload, r"(?<=WARC/)(?=1\.1\r\n)")
    cut = F.flatten(F.transform(quoted, lambda part: F.transform(
        F.sequence(F.lit(0), F.greatest(F.octet_length(part) - 1, F.lit(0)).cast("int"), F.lit(size)),
        lambda at: _bytes(part, at + 1, F.lit(size)))))
    framed = F.transform(F.filter(cut, lambda c: c != ""), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + CRLF + CRLF))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _safe(url: Column) -> Column:
    """A URL without the characters that would end a header line."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES,
            segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One archive record a row (value), without the blank lines after it.

    A block longer than ``segment_bytes`` is a response or revisit with segment number 1 and
    continuation records that name it; the last gives the whole length.
    """
    facts = with_revisits(payload_facts(pages))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(
        chunked(F.col("payload"), chunk_bytes)))
    named = facts.select(
        "page_id", _safe(F.col("url")).alias("uri"), "payload_bytes", "payload_digest", "refers_to",
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("id"), block.alias("block"))
    count = F.ceil(F.octet_length("block") / F.lit(segment_bytes)).cast("int")
    parts = named.withColumn("count", count).select(
        "*", F.explode(F.transform(F.sequence(F.lit(1), F.col("count")), lambda k: F.struct(
            k.alias("number"),
            _bytes(F.col("block"), (k - 1) * segment_bytes + 1, F.lit(segment_bytes)).alias("body"))
        )).alias("part")).drop("block")
    number, body = F.col("part.number"), F.col("part.body")
    first = number == 1
    own = F.when(first, F.col("id")).otherwise(F.concat_ws("-", "id", number))
    several = F.col("count") > 1
    head = F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.when(~first, "continuation").when(
            F.col("refers_to").isNotNull(), "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Segment-Number", F.when(several, number)),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.concat(F.lit("<"), "id", F.lit(">")))),
        _field("WARC-Segment-Total-Length", F.when(several & (number == F.col("count")),
                                                   (F.col("count") - 1) * segment_bytes
                                                   + F.octet_length(body))),
        F.when(first, F.concat(
            _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            _field("WARC-Profile", F.when(F.col("refers_to").isNotNull(), REVISIT_PROFILE)),
            _field("X-Payload-Length", F.col("payload_bytes")),
            _field("X-Page-ID", F.col("page_id")),
            _field("X-Refers-To-Page-ID", F.col("refers_to")),
            _field("Content-Type", F.lit("application/http;msgtype=response"))))
         .otherwise(F.lit("")),
        _field("Content-Length", F.octet_length(body)))
    return parts.select(F.concat(head, F.lit(CRLF), body).alias("value"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES,
                   segment_bytes: int = SEGMENT_BYTES, records_per_file: int = 100_000) -> None:
    """Compressed archive files under ``path``."""
    (records(pages, chunk_bytes, segment_bytes).write
     .option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: its header fields and body (bytes); ``cut``: the body is shorter than the
    header says."""
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path)
    head = F.substring_index("value", CRLF * 2, 1)

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
        return F.nullif(found, F.lit(""))

    split = raw.select(head.alias("head"), F.col("value").cast("binary").alias("value")).where(
        F.octet_length("value") > 0)
    length = field("Content-Length").try_cast("int")
    body = F.substring(F.col("value"), F.octet_length("head") + 5, length)
    return split.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"),
        field("WARC-Target-URI").alias("uri"),
        field("WARC-Segment-Number").try_cast("int").alias("segment"),
        field("WARC-Segment-Origin-ID").alias("origin"),
        field("WARC-Segment-Total-Length").try_cast("long").alias("total"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("told_digest"),
        field("X-Payload-Length").try_cast("long").alias("told_bytes"),
        field("X-Page-ID").try_cast("long").alias("page_id"),
        field("X-Refers-To-Page-ID").try_cast("long").alias("refers_to"),
        F.coalesce(body, F.lit("").cast("binary")).alias("body"),
        (F.coalesce(F.octet_length(body), F.lit(-1)) != F.coalesce(length, F.lit(-2))).alias("cut"))


_FIRST = ["type", "uri", "told_digest", "told_bytes", "page_id", "refers_to"]


def reassembled(read: DataFrame) -> DataFrame:
    """One row a record, segments joined: id, the fields of the first segment, block, and ``whole``:
    nothing is cut, segment numbers run from 1 without gap or repeat, and their lengths add up to
    the stated total.  Only segmented records are shuffled; a group is one record's own segments."""
    single = read.where("segment IS NULL").select(
        "id", *_FIRST, F.col("body").alias("block"), (~F.col("cut")).alias("whole"))
    parts = read.where("segment IS NOT NULL").withColumn("id", F.coalesce("origin", "id"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "body")))
    joined = parts.groupBy("id").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in _FIRST],
        ordered.alias("parts"), F.max("total").alias("total"), F.max("segment").alias("last"),
        F.count_distinct("segment").alias("numbers"), F.count(F.lit(1)).alias("count"),
        F.max("cut").alias("cut"), F.sum(F.octet_length("body")).alias("length"))
    whole = (~F.col("cut") & (F.col("last") == F.col("count"))
             & (F.col("numbers") == F.col("count")) & (F.col("total") == F.col("length")))
    block = F.array_join(F.transform("parts", lambda p: p["body"].cast("string")), "")
    return single.unionAll(joined.select("id", *_FIRST, block.cast("binary").alias("block"),
                                         F.coalesce(whole, F.lit(False)).alias("whole")))


CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;.*)?\Z")


def decode_chunks(data: bytes) -> bytes | None:
    """Undo chunked transfer framing; None if it is damaged: a size that is no plain hexadecimal
    number, a chunk or the end without its line end."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        told = CHUNK_SIZE.match(data, at, end) if end >= 0 else None
        if told is None:
            return None
        size, at = int(told.group(1), 16), end + 2
        if size == 0:
            # What may follow are trailer fields; an empty line ends them.
            return b"".join(out) if data[at:] == b"\r\n" or data.endswith(b"\r\n\r\n") else None
        if data[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(data[at:at + size])
        at += size + 2


def payloads(blocks: DataFrame) -> DataFrame:
    """``reassembled`` rows with payload (bytes) instead of block.  A chunked body is decoded; whole
    is false if its framing is damaged."""
    @F.pandas_udf("binary")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda block: None if block is None else decode_chunks(bytes(block)))

    text = F.col("block").cast("string")
    head = F.substring_index(text, CRLF * 2, 1)
    rest = F.substring(F.col("block"), F.octet_length(head) + 5, F.octet_length("block"))
    framed = F.regexp_like(head, F.lit(r"(?im)^Transfer-Encoding:[ \t]*chunked[ \t]*\r?$"))
    split = blocks.select("id", *_FIRST, "whole", rest.alias("rest"), (
        framed & (F.col("type") != "revisit")).alias("framed"))
    read = split.withColumn("decoded", decoded(F.when(F.col("framed"), F.col("rest"))))
    return read.select("id", *_FIRST, F.when(F.col("framed"), F.col("decoded")).otherwise(
        F.col("rest")).alias("payload"), (F.col("whole") & ~(
            F.col("framed") & F.col("decoded").isNull())).alias("whole"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a response or revisit record under ``path``: page_id, uri, record_type, payload,
    payload_bytes, payload_digest, refers_to and ``verified``.

    Bytes and digest of a response are those of the payload as read, those of a revisit stand in its
    header.  A damaged record is returned with verified = false; lengths and numbers in its header that
    are none, or too large, count as missing.  Records are told apart by the version line, so one of a
    foreign archive whose body quotes that line is cut there, and not verified.  Null or missing ids and URLs stay
    null; pages repeated in full are records of their own.  An empty table gives an empty result.
    """
    read = payloads(reassembled(read_records(spark, path)))
    revisit = F.col("type") == "revisit"
    digest = F.when(revisit, F.col("told_digest")).otherwise(F.sha1("payload"))
    return read.where(F.col("type").isin("response", "revisit")).select(
        "page_id", "uri", F.col("type").alias("record_type"), "payload",
        F.when(revisit, F.col("told_bytes")).otherwise(
            F.octet_length("payload").cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"), "refers_to",
        F.coalesce(F.col("whole") & (digest == F.col("told_digest")), F.lit(False)).alias("verified"))


#: What a round trip gives, in SQL.
ROUND_TRIP_SQL = """
WITH facts AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
largest AS (
  SELECT payload_digest, max(page_id) AS largest FROM facts WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM facts LEFT JOIN largest USING (payload_digest)
"""
