"""A content-addressed WARC archive.

Two tables in the shared folder make an archive: ``payloads`` holds each distinct payload once under its
SHA-256, ``headers`` the exact header bytes of every record. Reading joins both on the digest, checks the
digest of what it got, puts the original record together and parses it again. Identical payloads are
combined before the shuffle, so a payload that a third of all pages share is moved once for each task.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest id is the response and
the others revisit it. Results: null html counts as an empty payload; payloads below ``LEAST`` bytes are all
responses; repeated rows with the largest id of their payload are all responses; a null id is smaller than
any other; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

LEAST = 1000
_CRLF = "\r\n"


def _header(date: str) -> Column:
    """Header bytes of a record: WARC fields, an empty line, and the HTTP header of a response's block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    response = F.col("record_type") == "response"
    fields = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)).cast("string")),
    ]
    return F.concat(F.concat_ws(_CRLF, *fields), F.lit(_CRLF * 2), http).cast("binary")


def write(pages: DataFrame, id_col: str, url_col: str, html_col: str, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the archive of ``pages`` to ``folder``."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    (
        rows.groupBy("digest")
        .agg(F.max("id").alias("last_id"), F.first("payload").alias("payload"))
        .select("digest", "last_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "payload")
        .write.parquet(f"{folder}/payloads")
    )
    known = pages.sparkSession.read.parquet(f"{folder}/payloads").drop("payload")
    revisit = (F.col("payload_bytes") >= LEAST) & ~F.col("id").eqNullSafe(F.col("last_id"))
    records = (
        rows.select("id", "url", "digest")
        .join(known, "digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("last_id")))
    )
    records.select("digest", _header(date).alias("header")).write.parquet(f"{folder}/headers")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records as first written: ``header``, ``payload`` (what a revisit stands for, too),
    ``record`` (the bytes of the record; a revisit's block ends with its HTTP header)."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    joined = headers.join(payloads, "digest").select("header", checked.alias("payload"))
    block = F.when(F.col("header").cast("string").startswith("WARC/1.1\r\nWARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", block, F.lit((_CRLF * 2).encode())))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Parses the reconstructed records: ``id``, ``payload_bytes``, ``payload_digest`` (both of the full
    payload), ``record_type``, ``refers_to``, ``target_uri``."""
    head = F.substring_index(F.col("record").cast("string"), _CRLF * 2, 1)
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    page = lambda name: F.regexp_extract(F.col("head"), rf"(?m)^{name}: <urn:page:(-?\d+)>", 1)
    parsed = records(spark, folder).withColumn("head", head)
    warc_length = F.octet_length("head") + 4
    block = F.substring(F.col("record"), warc_length + 1, field("Content-Length").cast("int"))
    parsed = parsed.withColumn("block", block).withColumn("kind", field("WARC-Type"))
    # a response's payload is what its own block holds after the HTTP header, a revisit's what it stands for
    http_length = F.octet_length(F.substring_index(F.substring(F.col("block"), 1, 4096).cast("string"), _CRLF * 2, 1)) + 4
    body = F.when(F.col("kind") == "response", F.substring(F.col("block"), http_length + 1, F.octet_length("block"))).otherwise(F.col("payload"))
    number = lambda c: F.when(c != "", c).cast("long")
    parsed = parsed.select(
        number(page("WARC-Record-ID")).alias("id"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha1:([0-9a-f]*)", 1).alias("stated"),
    )
    return parsed.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload digest differs")))).drop("stated")


def archive(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Writes ``pages`` to a fresh archive in the shared folder and reads it back."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, id_col, url_col, html_col, folder)
    return read(pages.sparkSession, folder).withColumnRenamed("id", id_col)


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
l AS (SELECT payload_digest, max(page_id) AS last_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM d JOIN l USING (payload_digest)
"""
