"""A content-addressed web archive: payload bytes once, record headers apart, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.session import shared_folder

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF
URN = "urn:page:"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _read(name: str) -> Column:
    """The value of a header line; null where the header lacks it."""
    value = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)$", 1)
    return F.when(value != "", value)


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000,
) -> None:
    """Write one WARC record per row of ``pages`` below ``folder``.

    ``payloads`` holds each distinct payload once, under its SHA-256; ``headers`` holds the
    exact header block of every record and the address of its payload. Of the records with
    equal payloads of at least ``min_revisit`` bytes, the one with the largest id is a
    response and the others are revisits that refer to it; all smaller ones are responses.

    A null payload is an empty one. A null url gives a record without a target URI. A record
    with a null id has no record id, and is a response only if its payload is small or no
    other record of that payload has an id. Rows that repeat the largest id are all responses.
    Line breaks in a url are written as blanks.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.regexp_replace(F.col(url_col).cast("string"), "[\r\n]+", " ").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    # Grouped by (address, bytes): a digest that two different payloads share shows as two rows.
    held = rows.groupBy("address", "payload").agg(F.max("page_id").alias("keep_id"))
    held.select(
        "address", "payload", "keep_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("n_bytes"),
    ).write.parquet(f"{folder}/payloads")
    stored = pages.sparkSession.read.parquet(f"{folder}/payloads").select("address", "keep_id", "sha1", "n_bytes")
    if not stored.groupBy("address").count().filter("count > 1").isEmpty():
        raise ValueError("two payloads share a SHA-256 digest")
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    body = F.when(revisit, 0).otherwise(F.col("n_bytes")) + len(HTTP_HEAD)
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.col("page_id").cast("string"), F.lit(">"))),
        _field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{URN}"), F.col("keep_id").cast("string"), F.lit(">")))),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", body.cast("string")),
        F.lit(CRLF),
    )
    rows.select("page_id", "url", "address").join(stored, "address").select("address", header.alias("header")).write.parquet(f"{folder}/headers")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The records' headers, parsed: address, header, page_id, record_type, refers_to, payload_digest."""
    number = lambda name: F.regexp_extract(_read(name), rf"^<{URN}(-?[0-9]+)>$", 1).cast("bigint")
    return spark.read.parquet(f"{folder}/headers").select(
        "address", "header", number("WARC-Record-ID").alias("page_id"), _read("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), F.regexp_replace(_read("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
    )


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads: address, payload, verified. Both digests are taken again from the bytes."""
    held = spark.read.parquet(f"{folder}/payloads")
    good = (F.unhex(F.sha2("payload", 256)) == F.col("address")) & (F.sha1("payload") == F.col("sha1"))
    return held.select("address", "payload", good.alias("verified"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every original record: page_id, record_type, refers_to, payload_digest, payload_bytes, payload, record, verified.

    ``record`` holds the bytes of the WARC record: header, HTTP head, payload (none in a
    revisit) and the two closing line ends. ``verified`` tells whether the payload fits its address
    and the header's digest, the record is as long as its header says, and its block is that payload.
    A header whose payload is missing gives an unverified record.
    """
    records = read_headers(spark, folder).join(read_payloads(spark, folder), "address", "left")
    head, tail = F.lit(HTTP_HEAD.encode()), F.lit((CRLF * 2).encode())
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = records.withColumn("record", F.concat(F.col("header").cast("binary"), head, block, tail))
    start, length = F.octet_length("header"), _read("Content-Length").cast("bigint")
    body = F.substring(F.col("record"), start + len(HTTP_HEAD) + 1, (length - len(HTTP_HEAD)).cast("int"))
    intact = (F.octet_length("record") == start + length + len(CRLF * 2)) & ((F.col("record_type") == "revisit") | (F.sha1(body) == F.col("payload_digest")))
    good = F.col("verified") & (F.sha1("payload") == F.col("payload_digest")) & intact
    return whole.select(
        "page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload", "record", F.coalesce(good, F.lit(False)).alias("verified"),
    )


def archive_digest(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder, read its records back and report each one.

    Fails on a record that can't be rebuilt as its header and its payload's digests say.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "archive")
    write_archive(pages, folder, min_revisit=min_revisit)
    size = F.when(F.col("verified"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a stored record does not match its header or its payload's digest")).cast("bigint"))
    return read_records(spark, folder).select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
