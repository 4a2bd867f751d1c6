"""Content-addressed WARC archive (operator 5).

``write_archive`` keeps every payload once, under its SHA-256, and the exact header bytes
of every record in a second table. ``read_archive`` parses the headers and joins the two,
and so gives back each record byte by byte; it verifies each payload against its digest and
length. ``write_warc`` writes the joined records as WARC 1.1 files, compressed, and
``read_warc`` parses such files again, with the same verification, a record at a time.

Only one shuffle carries payloads while writing the archive: rows of one digest are combined
before it, so a payload that a third of the pages share travels once per task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this size are stored as responses even when they repeat.
REVISIT_BYTES = 100
# Names and profile of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CRLF = "\r\n"
#: Records of one WARC file; a task reads whole files.
RECORDS_PER_FILE = 10_000
#: Bytes of records that are given out together while a file is read.
_BATCH = 4 << 20

_RECORD_ID = r"<urn:page:(-?[0-9]*)>"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _one_line(value: Column) -> Column:
    """Header values must not break a line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def headers(date: str) -> Column:
    """The exact header block of a record, without the empty line that ends it."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat_ws(_CRLF, *lines)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive ``pages(page_id, url, html, ...)`` below ``path``.

    A null html is an empty payload, a null url an empty target. Of the records with equal
    payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page_id is the
    response and the others revisit it; rows that repeat this page_id are responses too,
    and a row without a page_id is a response unless a page with one has its payload. An
    empty table gives an empty archive. Other columns are not archived.
    """
    spark = pages.sparkSession
    records = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    (
        records.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page_id"), F.any_value("payload").alias("payload"))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .write.parquet(f"{path}/payloads", compression="zstd")
    )
    firsts = spark.read.parquet(f"{path}/payloads").select(
        F.struct("payload_digest").alias("_k"), "first_page_id", "payload_bytes"
    )
    again = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("first_page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page_id"))
    typed = (
        records.select("page_id", "url", "payload_digest", F.struct("payload_digest").alias("_k"))
        .join(firsts, "_k")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first_page_id")))
    )
    typed.select(F.encode(headers(date), "UTF-8").alias("header")).write.parquet(f"{path}/headers", compression="zstd")


def _field(header: Column, name: str) -> Column:
    """The value of a header line; null where the header has none."""
    return F.nullif(F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, f"^{_RECORD_ID}$", 1), F.lit("")).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, record_type, refers_to, payload_digest, payload_bytes, header,
    payload (the full one, also of a revisit). All but the payload and its length come from
    the header. A payload that doesn't have its digest, or a header whose digest names no
    payload or whose length isn't that of its body, fails the job."""
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.struct("payload_digest").alias("_k"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.sha2("payload", 256) == F.col("payload_digest")).alias("_sound"),
    )
    h = F.col("header")
    read = spark.read.parquet(f"{path}/headers").select(
        "header",
        _page(_field(h, "WARC-Record-ID")).alias("page_id"),
        _field(h, "WARC-Type").alias("record_type"),
        _page(_field(h, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_field(h, "WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        _field(h, "Content-Length").try_cast("long").alias("_length"),
    )
    joined = read.withColumn("_k", F.struct("payload_digest")).join(stored, "_k", "left")
    body = F.when(F.col("record_type") == "revisit", 0).when(F.col("record_type") == "response", F.col("payload_bytes"))
    sound = F.coalesce(F.col("_sound") & (F.col("_length") == body), F.lit(False))
    fault = F.raise_error(F.concat(F.lit("payload differs from its digest or its header: "), F.decode("header", "UTF-8")))
    checked = lambda c, kind: F.when(sound, F.col(c)).otherwise(fault.cast(kind)).alias(c)
    return joined.select(
        "page_id", checked("record_type", "string"), "refers_to", "payload_digest", checked("payload_bytes", "long"), "header", "payload"
    )


def record_bytes() -> Column:
    """A whole WARC record from the columns of ``read_archive``: header, empty line, body
    (none for a revisit) and the two line ends that close a record."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), F.lit((_CRLF * 2).encode()), body, F.lit((_CRLF * 2).encode()))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the records of ``read_archive`` as compressed WARC files of bounded size."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.decode("payload", "UTF-8"))
    text = F.concat(F.decode("header", "UTF-8"), F.lit(_CRLF * 2), body)
    records.select(text.alias("value")).write.options(
        lineSep=_CRLF * 2, compression="gzip", maxRecordsPerFile=records_per_file
    ).text(path)


def parsed_records(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Header bytes, header fields and body of each record of a WARC stream. A record that
    is cut short or isn't closed, or whose body doesn't have its digest, is an error."""
    while first := stream.readline():
        lines = [first]
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a header is cut short")
            lines.append(line)
        if first.rstrip(b"\r\n") != VERSION.encode():
            raise ValueError(f"no record begins with {first!r}")
        header = b"".join(lines).removesuffix(b"\r\n")
        fields = dict(line.decode().rstrip("\r\n").split(": ", 1) for line in lines[1:])
        body = stream.read(int(fields["Content-Length"]))
        if len(body) != int(fields["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"a record doesn't end where its header says: {fields}")
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(body).hexdigest():
            raise ValueError(f"a payload doesn't have its digest: {fields}")
        yield header, fields, body


_READ = "page_id long, record_type string, refers_to long, payload_digest string, content_length long, header binary"


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The records in the WARC files below ``path``: page_id, record_type, refers_to,
    payload_digest, content_length, header and, if wanted, body. Everything is parsed from
    the files; what doesn't fit its header fails the job."""

    def page(value: str | None) -> int | None:
        found = re.fullmatch(_RECORD_ID, value or "")
        if value is not None and not found:
            raise ValueError(f"no page has the id {value!r}")
        return int(found[1]) if found and found[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")] + ["body"] * bodies
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()] + [pa.binary()] * bodies
        out: list[tuple] = []
        size = 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)
                for header, f, body in parsed_records(stream):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    row = (page(f["WARC-Record-ID"]), f["WARC-Type"], page(f.get("WARC-Refers-To")), digest, len(body), header)
                    out.append((*row, body) if bodies else row)
                    size += len(header) + len(body) * bodies
                    if size > _BATCH:
                        yield given()
                        out, size = [], 0
        if out:
            yield given()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, _READ + ", body binary" * bodies)


def full_payloads(records: DataFrame) -> DataFrame:
    """``records`` of ``read_warc`` with ``payload_bytes``: the size of the full payload,
    which a revisit takes from a response of the same digest. One that names no response
    fails the job."""
    stored = (
        records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("content_length").alias("payload_bytes"))
        .select(F.struct("payload_digest").alias("_k"), "payload_bytes")
    )
    joined = records.withColumn("_k", F.struct("payload_digest")).join(stored, "_k", "left").drop("_k")
    fault = F.raise_error(F.concat(F.lit("no response has the payload "), F.col("payload_digest"))).cast("long")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", fault))
