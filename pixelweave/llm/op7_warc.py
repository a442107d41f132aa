"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds each distinct payload once under
its SHA-256. ``headers`` holds one row per record: the exact header bytes as
they stand in a WARC file, and the digest of the payload they describe. Reading
verifies every stored payload against its digest and joins headers to payloads;
a response is header, payload and two line ends, a revisit is a header that
refers to the response.

Equal payloads of at least ``least`` bytes: the record with the smallest id is
the response, the others are revisits of it. Smaller ones are responses, though
their payload is stored once too.

Defined results: a null payload is the empty one. A null id is larger than all
others: such a record revisits a record that has an id, else it is a response.
Rows that repeat the smallest id with the same payload are responses all. Line
ends in a URL are percent-encoded; a null URL has no header line. Payloads of
one digest are reduced in each task before they are shuffled, so a hot payload
moves once per task. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_folder, cut_lineage

NAME = "op7_warc_store"
LEAST = 100
_END = "\r\n"


def _header(kind: Column, page: Column, url: Column, digest: Column, length: Column, refers: Column) -> Column:
    """Header bytes of a record, its closing empty line included."""
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_END))).otherwise(F.lit(""))

    def urn(c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))

    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{_END}"), line("WARC-Type", kind), line("WARC-Record-ID", urn(page)),
        line("WARC-Target-URI", safe), F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{_END}"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", urn(refers)), F.lit(f"Content-Type: text/html{_END}"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")), F.lit(_END)).cast("binary")


def write_archive(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html",
                  least: int = LEAST) -> None:
    """Write the records of ``pages`` as an archive in ``folder``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    keyed = full.withColumn("digest", F.sha2("payload", 256))
    keyed.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    records = cut_lineage(keyed.select("page", "url", "digest", F.octet_length("payload").cast("bigint").alias("length")))
    first = records.where(F.col("length") >= least).groupBy("digest").agg(F.min("page").alias("first"))
    records = records.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    records.select(
        "digest", _header(kind, F.col("page"), F.col("url"), F.col("digest"), F.col("length"),
                          F.when(again, F.col("first"))).alias("header")
    ).write.parquet(f"{folder}/headers")


def _field(name: str, inner: str) -> Column:
    """A field's value. Fields end with CR LF alone; other line ends of Unicode may stand in a value."""
    text, line = F.col("header").cast("string"), rf"\r\n{name}: {inner}\r\n"
    return F.when(text.rlike(line), F.regexp_extract(text, line, 1))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The header rows with their fields parsed from the header bytes."""
    return spark.read.parquet(f"{folder}/headers").select(
        "digest", "header", _field("WARC-Type", "(response|revisit)").alias("record_type"),
        _field("WARC-Record-ID", r"<urn:page:([^\r\n]*)>").cast("bigint").alias("page_id"),
        _field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"),
        _field("WARC-Refers-To", r"<urn:page:([^\r\n]*)>").cast("bigint").alias("refers_to"))


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload, payload_bytes); a payload that doesn't match its digest raises."""
    stored = spark.read.parquet(f"{folder}/payloads")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return stored.select(good.alias("digest"), "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: parsed fields, ``payload`` and ``record``, the
    bytes of the WARC record as they stand in a file."""
    joined = read_headers(spark, folder).join(read_payloads(spark, folder), "digest")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat("header", block, F.lit(_END * 2).cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as an archive in the shared folder, rebuild the records,
    and measure what came back."""
    folder = f"{checkpoint_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(spark, folder).select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
