"""Content-addressed WARC archive (operator 10).

Two Parquet tables.  ``payloads`` holds each different payload once under its SHA-256,
``records`` holds every record's exact header block and the address of its payload.
Reading joins them, checks each payload against its address and length, and gives the
original records byte for byte.

Cases: null payload counts as empty; records without an id never stand for others unless
no record of the payload has one; repeated rows of the smallest id are all responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm.common import table
from oddsmith.sources.tables import scratch

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex SHA-1, five hex digits (four characters) at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``{path}/payloads`` and ``{path}/records``; payloads under ``least_bytes`` are never revisited."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    light = rows.select("id", "url", "address", F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("digest"))
    first = light.groupBy("address").agg(F.min("id").alias("first"))
    held = light.join(first, "address")
    response = (F.col("bytes") < least_bytes) | F.col("first").isNull() | F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    own, line = F.coalesce(F.col("id").cast("string"), F.lit("none")), lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), own, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(~response, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("bytes").cast("string")).otherwise("0")),
        F.lit("\r\n"),
    )
    held.select("id", "address", head.alias("head")).write.parquet(f"{path}/records")
    # one shuffle: each task keeps one row of an address before it sends any
    rows.select("address", "payload").dropDuplicates(["address"]).write.parquet(f"{path}/payloads")


def _field(name: str, value: str = "[^\r\n]*") -> Column:
    return F.nullif(F.regexp_extract("head", f"\r\n{name}: ({value})\r\n", 1), F.lit(""))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``id, address, head`` and the parsed fields of every record."""
    page = "<urn:page:(-?[0-9]+)>"
    return spark.read.parquet(f"{path}/records").select(
        "address", "head",
        F.nullif(F.regexp_extract("head", f"\r\nWARC-Record-ID: {page}\r\n", 1), F.lit("")).cast("long").alias("id"),
        _field("WARC-Type").alias("record_type"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("digest"),
        F.nullif(F.regexp_extract("head", f"\r\nWARC-Refers-To: {page}\r\n", 1), F.lit("")).cast("long").alias("refers_to"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``address, payload``; reading fails if a payload does not have its address."""
    found = spark.read.parquet(f"{path}/payloads")
    return found.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its address")).cast("binary")).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``id``, ``record_type``, ``record`` (header, block, end) and the full ``payload``."""
    both = read_headers(spark, path).join(read_payloads(spark, path), "address")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("id", "record_type", F.concat(F.col("head").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def archive_report(spark: SparkSession, folder: str) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder, read it back and describe every record."""
    path = scratch(spark, "warc")
    write_archive(table(spark, folder, "pages"), path)
    sizes = read_payloads(spark, path).select("address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    both = read_headers(spark, path).join(sizes, "address")
    agree = F.when(F.col("digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")))
    return both.select(F.col("id").alias("page_id"), "payload_bytes", agree.alias("payload_digest"), "record_type", "refers_to")


#: The hex digest is read five digits at a time as in ``base32``; ``sha1`` is built into DuckDB.
ARCHIVE_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT html, min(page_id) AS first_id FROM rows GROUP BY html),
digits AS (SELECT page_id, html, list_transform(range(32), lambda i:
    (('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) AS d FROM rows)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
    array_to_string(list_transform(d, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM digits JOIN firsts USING (html)
"""
