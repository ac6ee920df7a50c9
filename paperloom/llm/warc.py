"""WARC archives with revisit records.

Records' headers go by payload digest: of equal payloads that with the largest id is the response, the
others become revisit records without payload that name it. Only the archives hold payloads; they are
written through Spark's writer as whole records with fresh headers, a file per task, whose partitions follow the
payloads' bytes (before compression), and at most FILE_RECORDS records a file. Each file is one gzip stream, as the writer makes it. They
are read back file by file, each record by its Content-Length; a revisit's length and digest are those of the response
whose record it names, and a response that is missing raises an error.

Defined cases: null payload counts as empty and empties are equal; rows that repeat an id and payload are
all responses (of one record id if their url is the same, and a revisit names the one with the greatest url); payloads
under the least size are all responses; a null id sorts below all others and is written without a value; a payload is
held whole by its task, and a file by its reader, so a single record must stay under the 2 GB of a binary column; an
empty table writes an empty archive and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, parts_of, settings, shared_dir, text_or_empty

#: Records of a file at most.
FILE_RECORDS = 2000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(hex_digest):
    """Base32 of a SHA-1 in hexadecimal, by built-in functions: 40 digits are eight groups of five, each four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(8):
        value = F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_digest(pages: DataFrame, key: str, payload: str, date: str) -> DataFrame:
    body = text_or_empty(payload)
    return pages.select(F.col(key).cast("long").alias("id"), (F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")).alias("url"), body.alias("payload"), F.lit(date).alias("date")).select(
        "id", "url", "date", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1(F.col("payload").cast("binary")).alias("sha1")
    )


def resolve(records: DataFrame, least: int = 0) -> DataFrame:
    """records (id, url, sha1, size, ...) with keeper, the (id, url) of the response that a revisit refers to, null for responses."""
    headers = records.where(F.col("size") >= least).groupBy("id", "sha1").agg(F.max(F.coalesce("url", F.lit(""))).alias("url"))
    # a table of its own, so that a digest that a third of all pages share is split in the join
    keeper = cut_lineage(headers.groupBy("sha1").agg(F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "url")).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha1", "keeper"))
    revisits = headers.join(keeper, "sha1").where("id is null and keeper.some or id < keeper.id").select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "keeper")
    return records.join(revisits.hint("merge"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left").drop("r_id", "r_sha1")


def _record_id(key, sha1, url):
    name = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), sha1, url))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record():
    """One record as text: header lines, an empty line, the HTTP head and payload of responses; the writer ends it with two line ends."""
    eol, revisit = "\r\n", F.col("keeper").isNotNull()
    head = F.when(revisit, F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}{eol}")).otherwise(F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("size").cast("string"), F.lit(eol * 2)))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(eol))
    clean = lambda url: F.regexp_replace(url, r"[\r\n]", " ")
    return F.concat(
        F.lit(f"WARC/1.1{eol}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("sha1"), F.col("url"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        line("X-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("keeper.id"), F.col("sha1"), F.col("keeper.url"))),
                line("WARC-Refers-To-Target-URI", clean(F.col("keeper.url"))), line("WARC-Refers-To-Date", F.col("date")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.octet_length(head)).otherwise(F.octet_length(head) + F.col("size")).cast("string")),
        F.lit(eol),
        head,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0) -> None:
    """Deduplicated archives, gzip-compressed, below path."""
    records = with_digest(pages, key, payload, date)
    size = records.agg(F.sum("size")).first()[0] or 0
    # the last join deals the payloads by id and digest to as many tasks as their bytes ask for, and nothing joins small parts, which may be large ones well compressed
    with settings(pages.sparkSession, spark__sql__shuffle__partitions=parts_of(size), spark__sql__adaptive__coalescePartitions__enabled=False):
        resolve(records, least).select(_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): (.*)\r\n")


def parse_records(data: bytes):
    """(fields, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 2
        version = data.index(b"\r\n", at) + 2
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("WARC: no version line")
        fields = {k.decode(): v.decode() for k, v in _FIELD.findall(data[version:end])}
        size = int(fields["Content-Length"])
        block = data[end + 2 : end + 2 + size]
        if len(block) != size or data[end + 2 + size : end + 6 + size] != b"\r\n\r\n":
            raise ValueError("WARC: record cut short")
        yield fields, block
        at = end + 6 + size


def _read(batches):
    import zlib

    for batch in batches:
        for x in batch.column(0):
            data = zlib.decompress(x.as_buffer(), 31)
            rows = []
            for fields, block in parse_records(data):
                page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "revisit":
                    rows.append((fields["WARC-Record-ID"], page, None, digest, "revisit", fields["WARC-Refers-To"]))
                    continue
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if base32_sha1(payload) != digest:
                    raise ValueError("WARC: payload does not match its digest")
                rows.append((fields["WARC-Record-ID"], page, len(payload), digest, "response", None))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], RECORD)


RECORD = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "target"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; checks lengths and the digests of responses, and takes what a revisit has from the response that it names."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=1):
        found = cut_lineage(files.mapInArrow(_read, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, target string"))
    responses = found.where("record_type = 'response'")
    named = responses.groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(named.withColumnRenamed("record_id", "target"), "target", "left")
    missing = F.raise_error(F.concat(F.lit("WARC: no response "), F.col("target")))
    resolved = revisits.select("page_id", F.when(F.col("digest") == F.col("payload_digest"), F.col("bytes")).otherwise(missing.cast("long")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(resolved)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha, {1 + 5 * k}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages), m AS (SELECT sha, max(page_id) AS keeper FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN m USING (sha)
"""
