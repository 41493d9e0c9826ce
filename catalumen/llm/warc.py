"""WARC archives: write captures, read records back, and assemble request, response and metadata records.

A record ends with two line ends and the next begins with its version line, so
Spark's own text writer and reader carry archives as they are, at any size and in
any file system: one row is written for each capture, and a reader gets a row for
each version line. A payload that holds such a line itself is put together again
by the record's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.llm.base import query, small_batches, table, written
from catalumen.session import scratch_path

VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = "application/http;msgtype="
# The profile of a revisit with an equal payload, and the RFC 4648 digits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = ("record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
          "declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: ten hexadecimal digits are eight digits of base 32."""
    digest = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_uri(kind: str, *parts: Column) -> Column:
    """A record id that depends on the parts only; null parts are told apart from empty ones."""
    named = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts]
    h = F.md5(F.concat_ws("|", F.lit(kind), *named))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record(kind: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    return F.concat(
        F.lit(VERSION), header("WARC-Type", kind), *headers, header("Content-Type", F.lit(content_type)),
        header("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)


def with_revisits(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """``pages`` with length, digest and, where a larger key has the same payload, that page as ``original``."""
    full = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    full = full.withColumn("length", F.octet_length("payload").cast("long")).withColumn("digest", sha1_base32(F.col("payload")))
    shared = full.filter(F.col("length") >= least_bytes).groupBy("digest", "length").agg(
        F.max(F.struct("key", "url")).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    older = F.coalesce(F.col("key") < F.col("original.key"), F.col("key").isNull() & F.col("original.key").isNotNull())
    return full.join(shared, ["digest", "length"], "left").withColumn("original", F.when(older, F.col("original")))


def capture_text(pages: DataFrame) -> Column:
    """The request, the response or revisit, and the metadata record of a page."""
    own = [F.col("key"), F.col("digest"), F.col("length"), F.col("url")]
    response = record_uri("response", *own)
    original = record_uri("response", F.col("original.key"), F.col("digest"), F.col("length"), F.col("original.url"))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    common = [header("WARC-Target-URI", uri), header("WARC-Date", F.lit(DATE))]
    revisit = F.col("original").isNotNull()
    request = record(
        F.lit("request"), [header("WARC-Record-ID", record_uri("request", *own)), *common, header("WARC-Concurrent-To", response)],
        f"{HTTP}request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("length").cast("string"), F.lit("\r\n\r\n"))
    answer = record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        [header("WARC-Record-ID", response), *common, header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         header("WARC-Profile", F.when(revisit, F.lit(PROFILE))), header("WARC-Refers-To", F.when(revisit, original))],
        f"{HTTP}response", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    metadata = record(
        F.lit("metadata"), [header("WARC-Record-ID", record_uri("metadata", *own)), *common, header("WARC-Concurrent-To", response)],
        "application/warc-fields", F.concat(
            header("page-id", F.col("key")), header("payload-length", F.col("length")), header("refers-to-page-id", F.col("original.key"))))
    return F.concat_ws(RECORD_END, request, answer, metadata)


def write_captures(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    """Write three records for each page to gzipped archives below ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the largest key is a response and the others revisit it; pages that share
    that key are all responses. A null payload is empty, a null key counts as
    smaller than all others, and a line end in a url becomes a blank.
    """
    captures = with_revisits(pages, key, url, payload, least_bytes)
    captures.select(capture_text(captures).alias("value")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip").text(path)


def parsed(chunk: bytes, with_payload: bool) -> tuple | None:
    """One record from the bytes after its version line; None if it has no proper header or is cut short."""
    head, found, block = chunk.partition(b"\r\n\r\n")
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), []).append(value.strip())

    def one(name: str) -> str | None:
        return fields.get(name, [None])[0]

    if not found or not (one("content-length") or "").isdigit() or not one("warc-record-id"):
        return None
    if len(block) < int(one("content-length")):
        return None
    block = block[:int(one("content-length"))]
    content = (one("content-type") or "").replace(" ", "")
    payload = block.partition(b"\r\n\r\n")[2] if content.startswith("application/http") else block
    named = {}
    if content.startswith("application/warc-fields"):
        for line in block.decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                named[name.strip()] = value.strip()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (one("warc-record-id"), one("warc-type"), one("warc-target-uri"), one("warc-date"), fields.get("warc-concurrent-to", []),
            one("warc-refers-to"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None, len(payload), digest,
            list(named.items()), payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of gzipped archives, one row each, with the digest and length of the payload that is there.

    A file is one task's work and streams through it; only one record is held. Chunks without a record id
    or a length, and records shorter than their length, are passed over.
    """
    small_batches(spark)
    version = VERSION.encode()
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(),
                                 pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [field.split()[0] for field in RECORD.replace("map<string,string>", "map").split(", ")]

    def missing(chunk: bytes) -> bool:
        """True if the record says that it goes on beyond the chunk."""
        head, found, block = chunk.partition(b"\r\n\r\n")
        if not found:
            return False
        for line in head.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return len(block) < int(value)
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        held: list[bytes] = []
        open_file = None
        for batch in batches:
            rows = []
            for chunk, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist()):
                same, open_file = file == open_file, file
                if held and same and missing(version.join(held)):
                    held.append(chunk)
                    continue
                if held and (row := parsed(version.join(held), with_payload)):
                    rows.append(row)
                # A file begins with the empty text before its first version line.
                held = [chunk] if chunk else []
            if rows:
                yield batch_of(rows)
        if held and (row := parsed(version.join(held), with_payload)):
            yield batch_of([row])

    chunks = spark.read.option("lineSep", VERSION).option("pathGlobFilter", "*.gz").text(path)
    return chunks.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``(capture_id, response, requests, metadata)``.

    A capture is a response or revisit with the request and metadata records
    that name it, or that it names, as concurrent, directly or through one of
    these. ``response`` is the record; the others are lists by record id. Records
    that reach no response are left out, and a response without others has
    null lists. Records that are there twice are listed twice. ``records`` is
    read several times, so pass a written table.
    """
    whole = F.struct(*[c for c in records.columns if c != "type"])
    is_answer = F.col("type").isin("response", "revisit")
    links = records.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    answers = records.filter(is_answer).select(F.col("record_id").alias("capture"))
    # Each side may name the other.
    one_way = links.filter(~is_answer).select("record_id", "other")
    back = links.filter(is_answer).select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))
    edges = one_way.unionByName(back).distinct()
    direct = edges.join(answers, edges["other"] == answers["capture"], "left_semi").select("record_id", F.col("other").alias("capture"))
    through = edges.join(direct.select(F.col("record_id").alias("other"), "capture"), "other").join(
        direct, "record_id", "left_anti").select("record_id", "capture")
    placed = direct.unionByName(through).distinct()
    side = records.filter(F.col("type").isin("request", "metadata")).join(placed, "record_id").select(
        "capture", "type", F.struct("record_id", *[c for c in records.columns if c not in ("type", "record_id")]).alias("record"))

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("record"))), lambda a, b: F.when(
            a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))

    grouped = side.groupBy("capture").agg(listed("request").alias("requests"), listed("metadata").alias("metadata"))
    own = records.filter(is_answer).select(F.col("record_id").alias("capture"), F.col("type").alias("record_type"), whole.alias("response"))
    return own.join(grouped, "capture", "left").withColumnRenamed("capture", "capture_id")


SQL = """
WITH full_pages AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
latest AS (SELECT payload, max(page_id) AS original FROM full_pages GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  translate(lpad(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || substr(h, 11, 10))::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || substr(h, 21, 10))::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || substr(h, 31, 10))::BIGINT, 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < original THEN original END AS refers_to
FROM full_pages JOIN latest USING (payload)
"""


@query("op1_warc", SQL)
def op1_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_captures(table(spark, sf_dir, "pages"), path)
    captures = assemble(written(read_records(spark, path, with_payload=False), "records"))
    fields = F.element_at("metadata", 1)["fields"]
    revisit = F.col("record_type") == "revisit"
    return captures.select(
        fields["page-id"].cast("long").alias("page_id"),
        F.when(revisit, fields["payload-length"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.declared_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        "record_type", fields["refers-to-page-id"].cast("long").alias("refers_to"))
