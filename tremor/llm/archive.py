"""Content-addressed web archive in WARC files.

Payload bytes are stored once for each strong digest; the other records with these bytes are revisit records, which hold
headers alone and name the record that holds the payload. Files are WARC 1.1: a header block, an empty line, the payload,
and CR LF CR LF after each record. They are written by Spark's text sink with that record end, compressed by gzip. Payloads
are character data (UTF-8). Reading parses records by Content-Length, checks every payload against its digest, and keeps header
blocks exactly as they stand, apart from payloads; a join by digest gives the original records back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import new_path

MIN_SHARED = 100  # payloads under so many bytes are always stored in full
RECORDS_PER_FILE = 20_000
END = "\r\n\r\n"
HEADERS = "record_id string, refers_to_id string, record_type string, target_uri string, page_id long, header string, payload_digest string, payload_length long"


def _record_id(digest: Column, key: Column) -> Column:
    """A stable urn made of the record's own key."""
    h = F.sha2(F.concat_ws("|", digest, key.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, html, digest, length, record_type, refers_to).

    Null html is an empty payload. Among rows with equal payloads of ``min_shared`` bytes or more the smallest page_id is the
    response and the others revisit it; of rows alike in page_id too, each is a response. A row with a null page_id is a response.
    """
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"digest": F.sha2(F.col("html").cast("binary"), 256), "length": F.octet_length("html").cast("long")})
    shared = (base.where(F.col("length") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("head"), F.max("page_id").alias("last"))
              .where("head <> last").select("digest", "head"))
    return base.join(shared, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("head"), F.col("head"))).withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).drop("head")


def write(pages: DataFrame, path: str, min_shared: int = MIN_SHARED, date: str = "2020-01-01T00:00:00Z") -> None:
    """One WARC record for each row of ``pages`` into ``path``."""
    r = records(pages, min_shared)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("digest"), F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("digest"), F.col("refers_to")))), line("WARC-Refers-To-Target-Page", F.col("refers_to")), line("WARC-Page", F.col("page_id")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body)), F.lit("\r\n"))
    r.select(F.concat(header, body).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, payload) of each record."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", raw[at:stop])[1])
        yield raw[at:stop], raw[stop : stop + size]
        at = stop + size + 4


def _field(header: str, name: str) -> str | None:
    found = re.search(rf"^{name}: (.*?)\r$", header, re.M)
    return found[1] if found else None


def _read(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    import gzip

    names = ["record_id", "refers_to_id", "record_type", "target_uri", "page_id", "header", "payload_digest", "payload_length"] + ["payload"] * keep
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            for block, payload in parse(gzip.decompress(content.as_py())):
                header = block.decode()
                digest = _field(header, "WARC-Payload-Digest").removeprefix("sha256:")
                kind = _field(header, "WARC-Type")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {_field(header, 'WARC-Record-ID')} does not match its digest")
                page = _field(header, "WARC-Page")
                rows.append((_field(header, "WARC-Record-ID"), _field(header, "WARC-Refers-To"), kind, _field(header, "WARC-Target-URI"), int(page) if page else None, header, digest,
                             len(payload) if kind == "response" else None) + ((payload,) if keep else ()))
                if len(rows) == 1000:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = dict(page_id=pa.int64(), payload_length=pa.int64(), payload=pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names=names)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archive at ``path``: exact headers and, if asked for, payload bytes. A wrong digest is an error."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda it: _read(it, payloads), HEADERS + (", payload binary" if payloads else ""))


def reconstruct(archive: DataFrame) -> DataFrame:
    """Original records of ``read(..., payloads=True)``: each revisit with the payload of the record that it refers to."""
    full = archive.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("stored"), F.col("payload_digest").alias("stored_digest"))
    back = archive.where("record_type = 'revisit'").join(full.dropDuplicates(["refers_to_id"]), "refers_to_id")
    back = back.where("stored_digest = payload_digest").withColumn("payload", F.col("stored")).select(archive.columns)
    return archive.where("record_type = 'response'").unionByName(back).withColumn("payload_length", F.octet_length("payload").cast("long"))


def archived(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder, read it back and return page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response) for each record.

    An empty table gives an empty result. Extra columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, min_shared)
    heads = read(spark, path)
    stored = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("stored_page"), "payload_length", F.col("payload_digest").alias("stored_digest"))
    out = ["page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("stored_page").alias("refers_to")]
    plain = heads.where("record_type = 'response'").withColumn("stored_page", F.lit(None).cast("long")).select(*out)
    revisits = heads.where("record_type = 'revisit'").drop("payload_length").join(stored.dropDuplicates(["refers_to_id"]), "refers_to_id").where("stored_digest = payload_digest").select(*out)
    return plain.unionByName(revisits)
