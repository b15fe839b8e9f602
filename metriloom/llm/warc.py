"""Page archives, content-addressed: WARC records whose payload bytes are stored once.

An archive is a folder with two Parquet tables. ``payloads`` holds each different payload once under its
SHA-256, which is verified when it is read. ``headers`` holds per record the exact WARC header, the exact
HTTP header and the payload's key. ``read_archive`` joins them, and ``record`` puts the original bytes of
a record together. Of records with equal payloads of at least ``min_bytes`` the one with the smallest id
is a response, the others revisit it; smaller ones are all responses.

A null payload is empty. Null URLs give no target header, and control characters in a URL are escaped, so
no value can break a header. Rows repeated with the smallest id are all responses. Null ids count as
largest; a group without any id consists of responses. An empty table gives an empty archive. Only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal string of a multiple of 10 digits, 40 bits at a time."""
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 32), 8, "0")
        for at in range(1, 41, 10)
    ]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: str | Column) -> Column:
    return base32(F.sha1(payload))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _escaped(url: str) -> Column:
    """The URL with line ends, tabs and blanks percent-encoded; other control characters become %00."""
    out = F.col(url)
    for c in "\t\n\r ":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(out, r"[\x00-\x1F\x7F]", "%00")


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = DATE):
    """(headers, payloads) of the archive, not written yet."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("payload_key")
    )
    first = rows.groupBy("payload_key").agg(F.min("id").alias("first"))
    marked = rows.select(
        "id", "url", "payload_key", F.octet_length("payload").alias("n"), sha1_base32("payload").alias("digest")
    ).join(first, "payload_key")
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2)
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(_line("WARC-Target-URI", _escaped("url")), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        ).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    headers = marked.select(F.encode(warc, "UTF-8").alias("warc_header"), F.encode(http, "UTF-8").alias("http_header"), "payload_key")
    return headers, rows.select("payload_key", "payload").dropDuplicates(["payload_key"])


def write_archive(pages: DataFrame, path: str, **columns) -> str:
    """Write the two tables of an archive below ``path``."""
    headers, payloads = to_records(pages, **columns)
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def field(name: str) -> Column:
    """A field of the WARC header; null if it has none."""
    found = F.regexp_extract(F.decode("warc_header", "UTF-8"), rf"\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``id, type, refers_to, url, digest``, the full payload with its size, and whether
    the bytes have the digests that they are stored under (``verified``)."""
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "payload_key",
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32("payload").alias("payload_sha1"),
        (F.sha2("payload", 256) == F.lower(F.hex("payload_key"))).alias("intact"),
    )
    headers = spark.read.parquet(f"{path}/headers")
    joined = headers.join(payloads, "payload_key", "left")
    return joined.select(
        F.regexp_extract(field("WARC-Record-ID"), "<urn:page:(.*)>", 1).alias("id"),
        field("WARC-Type").alias("type"),
        F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("digest"),
        "warc_header",
        "http_header",
        "payload",
        "payload_bytes",
        (F.coalesce("intact", F.lit(False)) & (F.col("payload_sha1") == F.substring(field("WARC-Payload-Digest"), 6, 32))).alias("verified"),
    )


def record(payload: str = "payload") -> Column:
    """The original bytes of a record that ``read_archive`` gave."""
    body = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col(payload))
    return F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n"))
