"""WARC archives: writing, reading, and revisit resolution by payload digest.

resolve() shuffles headers only (key, digest, length), takes the largest key of each digest by a partial aggregate, and
joins it back to the headers. write() joins the decisions to the payloads by (key, digest), which spreads a payload that
a third of all records share, and writes deduplicated archives with fresh headers through Spark's text sink, so that
any Hadoop file system and its commit protocol serve. read() takes the archives as binary files and parses them by
Content-Length, never by searching payloads for markers.

Defined results: a null payload is empty; records of equal payloads of min_bytes or more revisit the one with the
largest key, and records with that same key and payload (repeated rows) are all responses; smaller payloads are all
responses; a null key counts as the smallest and refers_to is null for its revisits only if all keys are null (then all
are responses). An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import scratch, table

MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
SERVER_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: each 5 hexadecimal digits are 4 digits of base 32, whose letters are then renamed."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(records: DataFrame, key: str, payload: str) -> DataFrame:
    """Key, digest and length of each record."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    return records.select(F.col(key).alias("key"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))


def resolve(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """key, digest and refers_to: null for a response, else the key of the response that it revisits; one row a pair."""
    pairs = heads.filter(F.col("n_bytes") >= min_bytes).select("key", "digest").distinct()
    # A digest of one key needs no join: only what repeats meets its original.
    originals = pairs.groupBy("digest").agg(F.max("key").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original")
    return pairs.join(originals, "digest").filter("original is not null and not (key <=> original)").select("key", "digest", F.col("original").alias("refers_to"))


def records(source: DataFrame, key: str, url: str, payload: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One WARC record for each row, as text without its closing blank lines."""
    decided = resolve(headers(source, key, payload), min_bytes).select(F.col("key").alias("_k"), F.col("digest").alias("_d"), "refers_to")
    rows = source.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("n_bytes", F.octet_length("payload"))
    rows = rows.join(decided, F.col("key").eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_d")), "left")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:x-record:"), c.cast("string"), F.lit(">"))
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), F.when(F.col("key").isNull(), "").otherwise(line("WARC-Record-ID", urn(F.col("key")))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-X-Payload-Length", F.col("n_bytes").cast("string")), F.when(revisit, F.concat(line("WARC-Profile", F.lit(SERVER_PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))), F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    ).alias("value"))


def write(source: DataFrame, path: str, key: str, url: str, payload: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives under path: gzip files of whole records."""
    records(source, key, url, payload, min_bytes).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """Blocks of the plain bytes of one gzip file of one or more members."""
    while data:
        unzip = zlib.decompressobj(31)
        while data and not unzip.eof:
            yield unzip.decompress(data, 1 << 20)
            data = unzip.unconsumed_tail or unzip.unused_data
        if not unzip.eof:
            yield unzip.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names; the version line is named version) and content of each record of a gzip file."""
    plain, buf, at = _inflated(data), bytearray(), 0

    def have(n: int) -> bool:
        while len(buf) < n and (more := next(plain, None)) is not None:
            buf.extend(more)
        return len(buf) >= n

    while True:
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            size = len(buf)
            if not have(size + 1):
                if size > at:
                    raise ValueError("an archive ends inside a header")
                return
        first, *rest = buf[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {first[:40]!r}")
        fields = {"version": first} | {n.strip().lower(): v.strip() for n, v in (x.split(":", 1) for x in rest)}
        size = int(fields["content-length"])
        if not have(end + 4 + size + 4):
            raise ValueError("an archive ends inside a record")
        yield fields, bytes(buf[end + 4 : end + 4 + size])
        at = end + 4 + size + 4
        if at > 1 << 22:
            del buf[:at]
            at = 0


def _id(urn: str | None) -> str | None:
    return urn[len("<urn:x-record:") : -1] if urn else None


def read(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """The records under path; a response's length and digest are taken from its content, a revisit's from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for data in b.column(0):
                out: list[tuple] = []
                for f, content in parse(data.as_py()):
                    n, digest = int(f["warc-x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response":
                        n, found = len(content), base64.b32encode(hashlib.sha1(content).digest()).decode()
                        if found != digest:
                            raise ValueError(f"record {f.get('warc-record-id')}: digest {digest}, content {found}")
                    out.append((_id(f.get("warc-record-id")), f["warc-target-uri"], n, digest, f["warc-type"], _id(f.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(run, "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast(key_type) for c in ("key", "refers_to")})


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return read(spark, path).drop("url").withColumnRenamed("key", "page_id")


OP2_SQL = """
WITH alphabet AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a),
p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS x FROM p),
v AS (SELECT page_id, payload_bytes, x, [CAST(('0x' || substr(x, 1 + 5 * k, 5)) AS BIGINT) FOR k IN range(8)] AS fives FROM h),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(fives, lambda f: substr(a, CAST((f >> 15) & 31 AS INT) + 1, 1) || substr(a, CAST((f >> 10) & 31 AS INT) + 1, 1)
  || substr(a, CAST((f >> 5) & 31 AS INT) + 1, 1) || substr(a, CAST(f & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest FROM v, alphabet),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to FROM m
"""
