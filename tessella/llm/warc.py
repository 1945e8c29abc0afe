"""A content-addressed WARC archive.

write_archive() stores two Parquet tables in a folder: `payloads`, each distinct payload once
under its SHA-256, and `headers`, the exact header block of each record with its payload's
digest and nothing else. read_archive() joins them, rebuilds each original record byte for byte
and parses it: all it returns is read from the rebuilt record.

Digests are verified: on writing, rows of one SHA-256 must agree in length, SHA-1 and XXH64;
on reading, each rebuilt record's payload is hashed again and must have the SHA-256 it is stored
under and the SHA-1 that its header states, and the block must have the stated length.

Of records with equal payloads of at least `least` bytes the one with the smallest id is a
response and the others are revisits; smaller ones are all responses. Null payloads and
addresses are empty; a null id comes last; rows that repeat the smallest id are the same record, all
responses; an empty table makes an empty archive; other columns are ignored.

Payloads are compressed before they are shuffled and stored. One payload may be that of a
third of all records: groups are aggregated before they are shuffled, and for reading the records
of such a payload are dealt over parts by a hash of the header, each part with the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm._common import field, hot_rows, join_one, materialize, slices

HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def record_headers(kind, page, url, sha1, size, refers):
    """The WARC header block up to and with its empty line, and the HTTP head. Line ends in an address are percent-encoded."""
    head = F.format_string(HEAD, size)
    block = F.when(kind == "response", F.length(head) + size).otherwise(F.length(head))
    named = F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")))
    address = F.replace(F.replace(F.coalesce(url.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), named, F.lit(">\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), sha1,
        F.when(kind == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"), head,
    )


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_archive(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """payload_col: string (stored as UTF-8) or binary."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    own = [field(pages, id_col, "page_id"), T.StructField("url", T.StringType()), T.StructField("sha256", T.BinaryType())]
    about = T.StructType([*own, T.StructField("bytes", T.LongType()), T.StructField("sha1", T.StringType()), T.StructField("xx", T.LongType())])
    stored = T.StructType([own[0], own[2], T.StructField("payload", T.BinaryType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = batch.column(2).to_pylist()
            columns = ([hashlib.sha256(d).digest() for d in data], pa.binary()), (list(map(len, data)), pa.int64()), (list(map(base32_sha1, data)), pa.string()), ([xxhash.xxh64_intdigest(d) - (1 << 63) for d in data], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in columns)], names=about.names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            data = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()), pa.array(map(press, data), pa.binary())], names=stored.names)

    slim = materialize(source.mapInArrow(digests, about), "digests")
    ends = [f(c).alias(f"{name}_{c}") for c in ("bytes", "sha1", "xx") for name, f in (("a", F.min), ("b", F.max))]
    groups = slim.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *ends)
    clash = (F.col("a_bytes") != F.col("b_bytes")) | (F.col("a_sha1") != F.col("b_sha1")) | (F.col("a_xx") != F.col("b_xx"))
    groups = groups.select(F.when(clash, F.raise_error(F.lit("different payloads have one SHA-256"))).otherwise(F.col("sha256")).alias("sha256"), "first_id", "n")
    # One key string for both columns, null too: the join's partitions serve the removal of repeated rows, so payloads are shuffled once.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    first = groups.select(F.col("sha256").alias("g"), F.coalesce(F.col("first_id").cast("string"), F.lit("null")).alias("g_key"), F.col("n").alias("records"))
    kept = source.mapInArrow(packed, stored).select("sha256", key.alias("key"), "payload").join(first, (F.col("sha256") == F.col("g")) & (F.col("key") == F.col("g_key")))
    kept.dropDuplicates(["sha256", "key"]).select("sha256", "records", "payload").write.option("compression", "none").parquet(f"{path}/payloads")
    revisit = (F.col("n") > 1) & (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = join_one(slim, groups, "sha256").withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    header = record_headers(F.col("record_type"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("bytes"), F.col("refers_to"))
    typed.select("sha256", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def parsed(record: bytes) -> tuple:
    """(page id, address, record type, refers to, stated digest, HTTP head, body) of a record; ids as they are written, None for null."""
    head, _, block = record.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if len(block) != int(fields["Content-Length"]) + len(END) or not block.endswith(END):
        raise ValueError("a record's block does not have the stated length")
    http, _, body = block[: -len(END)].partition(END)
    ids = [re.fullmatch(r"<urn:page:(.*)>", fields[k])[1] if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
    return (None if ids[0] == "null" else ids[0], fields["WARC-Target-URI"], fields["WARC-Type"], ids[1], fields["WARC-Payload-Digest"].removeprefix("sha1:"), http, body)


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """header and payload (compressed) of each record, and the digest it is stored under; a payload is with its records in one task, unless they are many."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    most = hot_rows(headers.count())
    hot = payloads.where(F.col("records") > most).select("sha256", F.ceil(F.col("records") / most).cast("int").alias("parts"))
    if hot.isEmpty():
        return headers.join(payloads, "sha256").select("sha256", "header", "payload")
    few = F.broadcast(hot)  # a digest and a number, fewer than HOT_SHARE rows
    dealt = headers.join(few, "sha256", "left").select("sha256", "header", F.coalesce(F.pmod(F.xxhash64("header"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    copies = payloads.join(few, "sha256", "left").select("sha256", "payload", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    return dealt.join(copies, ["sha256", "part"]).select("sha256", "header", "payload")


def records(spark: SparkSession, path: str, whole: bool, id_type: T.DataType) -> DataFrame:
    fields = [T.StructField("page_id", id_type), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type)]
    more = [T.StructField("payload", T.BinaryType()), T.StructField("record", T.BinaryType())] if whole else [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())]
    schema = T.StructType([*fields, *more])
    as_id = int if isinstance(id_type, T.IntegralType) else str
    types = [to_arrow_type(f.dataType) for f in schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def unpress(data: bytes) -> bytes:
            try:
                return press.decompress(data, allow_extra_data=False)
            except zstandard.ZstdError as e:
                raise ValueError("a stored payload does not have its digest: it can't be read") from e

        for batch in slices(batches):
            out = []
            for sha256, header, pressed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = unpress(pressed)
                record = header + (payload if b"\r\nWARC-Type: response\r\n" in header.partition(END)[0] else b"") + END
                page, url, kind, refers, digest, _, body = parsed(record)
                if hashlib.sha256(payload).digest() != sha256 or base32_sha1(payload) != digest or kind == "response" and body != payload:
                    raise ValueError("a stored payload does not have its digest")
                ids = [None if x is None else as_id(x) for x in (page, refers)]
                out.append((ids[0], url, kind, ids[1], *((payload, record) if whole else (len(payload), digest))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return rebuilt(spark, path).mapInArrow(read, schema)


def read_archive(spark: SparkSession, path: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """The original records, rebuilt and parsed: page_id, url, record_type, refers_to, payload and record, the record's bytes in WARC form."""
    return records(spark, path, True, id_type)


def archive_index(spark: SparkSession, path: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """What the rebuilt records say, without their bytes: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records(spark, path, False, id_type).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
