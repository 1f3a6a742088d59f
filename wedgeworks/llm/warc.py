"""Content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds the bytes of every distinct payload once, keyed
by SHA-256 and length. ``headers`` holds, for each record, the exact header bytes (WARC header and, for a
response, the HTTP header) with the payload's key. Records are put together again by joining the two; a
revisit record has headers only, and its payload comes from the record it refers to.

Reading verifies: the digest of the stored bytes is computed again and must equal the key, the lengths in
the header must equal the bytes that follow it, and the header must name the same digest; else the read
fails. ``export_warc`` writes standard .warc files, ``import_warc`` reads them back.

Defined results: a null payload is empty; payloads under ``revisit_from`` bytes are always responses; of
equal larger payloads the record with the smallest id is the response (rows that repeat that id too), and
a null id counts as the largest. CR, LF and blanks in urls are percent-encoded in headers.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, table

CRLF = "\r\n"
REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts):
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _uri(url):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A"), " ", "%20")


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", revisit_from: int = REVISIT_FROM, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record per row. The payload column may be text (stored as UTF-8) or binary."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    keyed = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload").cast("long")})
    # copies meet before the shuffle; each digest keeps its bytes once, with the record that has the smallest id
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    keyed.groupBy("digest", "n").agg(F.any_value("payload").alias("payload"), first.alias("first")).select(
        "digest", "n", "payload", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")
    ).write.parquet(f"{path}/payloads")
    firsts = spark.read.parquet(f"{path}/payloads").select("digest", "n", "first_id", "first_url")
    # rows that are equal in all are numbered, so that each record has an id of its own
    twin = W.partitionBy("digest", "n", "page_id", "url").orderBy(F.lit(0))
    named = keyed.drop("payload").join(firsts, ["digest", "n"]).withColumn("twin", F.row_number().over(twin))
    own = F.when(F.col("twin") > 1, F.col("twin"))
    revisit = (F.col("n") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF * 2))
    block = F.when(revisit, 0).otherwise(F.length(http) + F.col("n"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _uuid(F.col("page_id"), F.col("url"), F.col("digest"), own),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), _uri(F.col("url")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{CRLF}X-Record-Key: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}X-Payload-Length: "), F.col("n"),
        F.when(revisit, F.concat(
            F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _uuid(F.col("first_id"), F.col("first_url"), F.col("digest"), F.lit(None)),
            F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), _uri(F.col("first_url")),
            F.lit(f"{CRLF}X-Refers-To-Key: "), F.coalesce(F.col("first_id").cast("string"), F.lit("")),
        )).otherwise(F.lit(f"{CRLF}Content-Type: application/http;msgtype=response")),
        F.lit(f"{CRLF}Content-Length: "), block, F.lit(CRLF * 2),
    )
    header = F.when(revisit, warc).otherwise(F.concat(warc, http))
    named.select("digest", "n", F.when(revisit, "revisit").otherwise("response").alias("kind"), header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, kind, header, payload): headers joined with the stored bytes, null for a revisit."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    full = headers.where("kind = 'response'").join(payloads.select("digest", "n", "payload"), ["digest", "n"])
    bare = headers.where("kind = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    return full.unionByName(bare)


def restore_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its full payload, revisits through the record they refer to; null if its bytes are lost."""
    return spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads").select("digest", "n", "payload"), ["digest", "n"], "left")


def _field(header, name: str):
    return F.regexp_extract(header, rf"(?m)^{name}: ?([^\r\n]*)", 1)


def verified(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Parses every record of an archive; fails on bytes, lengths or digests that don't agree.

    Records are put together first: what is hashed and measured is each record's own rebuilt payload.
    """
    text = F.col("header").cast("string")
    rows = restore_payloads(spark, path).select(
        _field(text, "X-Record-Key").alias("key"), _field(text, "WARC-Type").alias("record_type"),
        F.regexp_replace(_field(text, "WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        _field(text, "X-Payload-Length").cast("long").alias("payload_bytes"), _field(text, "X-Refers-To-Key").alias("refers"),
        F.regexp_extract(text, r"(?m)^Content-Length: ?(\d+)", 1).cast("long").alias("block"),
        (F.length(text) - F.instr(text, CRLF * 2) - 3).cast("long").alias("http"), F.sha2("payload", 256).alias("hashed"), F.length("payload").cast("long").alias("held"),
    )
    whole = F.col("payload_digest").eqNullSafe(F.col("hashed")) & F.col("payload_bytes").eqNullSafe(F.col("held")) & (
        F.col("block") == F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("http") + F.col("held"))
    )
    failed = F.raise_error(F.concat(F.lit("damaged record "), F.col("key"))).cast("string")
    rows = rows.withColumn("payload_digest", F.when(whole, F.col("payload_digest")).otherwise(failed))
    nothing = F.lit(None).cast(id_type)
    return rows.select(
        F.when(F.col("key") != "", F.col("key").cast(id_type)).otherwise(nothing).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when((F.col("record_type") == "revisit") & (F.col("refers") != ""), F.col("refers").cast(id_type)).otherwise(nothing).alias("refers_to"),
    )


def export_warc(spark: SparkSession, path: str, out: str, compression: str = "none", max_records: int = 100_000) -> None:
    """Writes the archive as .warc files, raw bytes: header, payload, two line ends."""
    block = F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r")).cast("string")
    read_records(spark, path).select(block).write.option("lineSep", "\n").option("compression", compression).option("maxRecordsPerFile", max_records).text(out)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header with HTTP header, payload) of each record of a .warc or .warc.gz file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:])}
        block = data[end : end + int(fields.get(b"content-length", b"0"))]
        cut = block.find(b"\r\n\r\n") + 4 if fields.get(b"content-type", b"").startswith(b"application/http") else 0
        yield data[at:end] + block[:cut], block[cut:]
        at = end + len(block)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record of the .warc files under a folder; a file is one task's work."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for header, payload in parse_warc(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([header], pa.binary()), pa.array([payload], pa.binary())], names=["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, "header binary, payload binary")


def op2_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return verified(spark, path)


SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
k as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from k)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f
"""
