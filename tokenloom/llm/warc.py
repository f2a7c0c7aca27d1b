"""WARC archives with revisit resolution.

Headers alone - page id, payload length and digest - are shuffled by digest to find the
response of every group of equal payloads; the pages learn from it by page id which
record they become. Archives are written with Spark's text writer, whose line separator
is the record separator of the format, and read back by ``Content-Length``.

A null html is an empty payload and a null url leaves out the target header. Pages of
equal payload that tie on the largest page id all stay responses. A page without an id
is a response that nothing refers to. Columns other than the three named ones are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import materialise, scratch_path

MIN_REVISIT_BYTES = 1000
#: Keeps an archive small enough to be read whole by one task.
RECORDS_PER_ARCHIVE = 4096

# Fixed values of the archive format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)


def _headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, payload_digest, refers_to)`` of every page that revisits another one."""
    headers = _headers(pages).where(
        (F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()
    )
    originals = (
        headers.groupBy("payload_digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # Stored, so that the join has two plain exchanges and a frequent digest can be split.
    originals = materialise(originals, "warc-originals")
    return (
        headers.select("page_id", "payload_digest")
        .join(originals, "payload_digest")
        .where(F.col("page_id") < F.col("refers_to"))
        .dropDuplicates(["page_id", "payload_digest"])
    )


def _record_id(name: Column) -> Column:
    """A record id in the form of a UUID, the same in every run."""
    h = F.md5(name.cast("string"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">")
    )


def _safe_uri(url: Column) -> Column:
    """A url without the characters that would end or fold a header line."""
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(raw), F.lit(coded))
    return url


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def to_records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One text column ``value``: the WARC record of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("html"),
    ).withColumn("payload_digest", F.sha1("html"))
    known = rows.where(F.col("page_id").isNotNull())
    without_id = rows.where(F.col("page_id").isNull()).withColumn(
        "refers_to", F.lit(None).cast("long")
    )
    linked = known.join(revisits, ["page_id", "payload_digest"], "left")
    rows = linked.unionByName(without_id)
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(RECORD_END),
    )
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    named = F.concat(F.coalesce(F.col("url"), F.lit("")), F.lit(" "), F.col("payload_digest"))
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        _line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.coalesce(F.col("page_id").cast("string"), named))),
        _line("WARC-Date", F.lit(CAPTURE_DATE)),
        _line("WARC-Target-URI", _safe_uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(is_revisit, _record_id(F.col("refers_to")))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page-Id", F.col("refers_to")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one WARC record per page to gzip archives of bounded size under ``path``."""
    records = to_records(pages, resolve_revisits(pages, min_bytes))
    (
        records.write.option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE)
        .option("compression", "gzip")
        .text(path)
    )


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of one archive."""
    at, end = 0, len(content)
    while at < end:
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        start = stop + 4
        length = int(head["content-length"])
        yield head, content[start : start + length]
        at = start + length + 4


def _record_row(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = next(
        int(line.split(b":")[1])
        for line in http.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    number = lambda name: int(head[name]) if name in head else None
    return (
        number("x-page-id"),
        head.get("warc-target-uri"),
        head["warc-type"],
        whole,
        head["warc-payload-digest"].removeprefix("sha1:"),
        number("x-refers-to-page-id"),
        payload if head["warc-type"] == "response" else None,
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` from archives; revisits have a null payload."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kept = len(names) if payloads else len(names) - 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                archive = gzip.decompress(content.as_py())
                rows = [_record_row(*r)[:kept] for r in parse_archive(archive)]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(columns, names[:kept])

    files = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.rpartition(",")[0]
    return files.mapInArrow(parse, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives to the shared scratch folder and read their records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, payloads=False)
