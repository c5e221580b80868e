"""WARC archives in which repeated payloads are stored once.

Writing: headers (id, digest, length) are shuffled by payload digest, never the payloads. Of the
records with the same payload of at least ``least_bytes`` bytes, the one with the smallest id is written
as a response and the others as revisit records that refer to it. Records are shuffled once by
row, which sizes the archive files, and written by Spark's text sink: a record ends in two line
ends, which is the sink's separator, and the sink commits whole files only, so lost executors leave no
halves. Files are compressed with gzip.

Reading: every file is framed by the lengths in its headers. ``resolve`` joins revisit records with their
original responses.

Cases: a null payload is an empty one; null ids come after all others and are written as ``null``; a
null or unprintable URL is left out or percent-encoded; of repeated rows (same id and payload) one
is the response; payloads may hold line ends and text that looks like a record.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.order import Numbered
from gridlens.session import materialize

END = "\r\n"
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that a task hands on at once.
READ_BYTES = 8_000_000
SCHEMA = "record_id string, id string, record_type string, url string, refers_to string, digest string, payload binary"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(id.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write one record per row as ``*.txt.gz`` archives under ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = Numbered(pages).select(id=F.col(id), url=F.col(url).cast("string"), body=body)
    rows = rows.withColumns({"digest": F.sha2("body", 256), "bytes": F.octet_length("body")})
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    heads = materialize(rows.where(F.col("bytes") >= least_bytes).select("row", "id", "digest"), "warc-headers")
    originals = materialize(
        heads.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "warc-originals"
    )
    revisits = heads.join(originals, "digest").where(F.col("first.row") != F.col("row"))
    revisits = revisits.select(F.col("row").alias("revisit"), _record_id(F.col("first.id"), F.col("first.row")).alias("refers_to"))

    again = F.col("refers_to").isNotNull()
    sent = F.when(again, F.lit(b"")).otherwise(F.col("body"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    # characters that must not stand in a header are percent-encoded
    safe_url = F.when(F.col("url").rlike("[\\x00-\\x20\\x7f]"), F.regexp_replace(F.url_encode("url"), "\\+", "%20")).otherwise(F.col("url"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("id"), F.col("row"))),
        _header("WARC-Date", F.lit(dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        _header("WARC-Target-URI", safe_url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(again, PROFILE)),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", (F.octet_length("http") + F.octet_length("sent")).cast("string")),
        F.lit(END),
    )
    records = rows.join(revisits, F.col("row") == F.col("revisit"), "left").withColumns({"http": http, "sent": sent})
    # the cast keeps the bytes as they are; the sink writes them unchanged
    whole = F.concat(header.cast("binary"), F.col("http").cast("binary"), F.col("sent")).cast("string")
    records.select(whole.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of one archive, as in ``SCHEMA``."""
    while line := archive.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip(END).partition(": ")
            fields[name.lower()] = value
        block = archive.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("an archive ends inside a record")
        payload = block.partition(b"\r\n\r\n")[2]
        kind, record = fields["warc-type"], fields["warc-record-id"]
        id = record.removeprefix("<urn:record:").rpartition(":")[0]
        yield (
            record, None if id == "null" else id, kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest", "").removeprefix("sha256:"), None if kind == "revisit" else payload,
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: ``SCHEMA``; revisit records have a null payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                with gzip.open(io.BytesIO(content.as_buffer())) as archive:
                    for record in parse(archive):
                        held.append(record)
                        size += len(record[-1] or b"")
                        if size > READ_BYTES or len(held) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, SCHEMA)


def resolve(records: DataFrame, carry: list[str]) -> DataFrame:
    """Every record with the columns ``carry`` of its response and ``original_id``, the id of the response it refers to."""
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("original"), F.col("id").alias("original_id"), *[F.col(c).alias(f"original_{c}") for c in carry]
    )
    joined = records.join(responses, F.col("refers_to") == F.col("original"), "left")
    own = [F.when(F.col("record_type") == "revisit", F.col(f"original_{c}")).otherwise(F.col(c)).alias(c) for c in carry]
    return joined.select(*[c for c in records.columns if c not in carry], *own, "original_id")
