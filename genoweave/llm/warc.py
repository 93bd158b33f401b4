"""WARC writing and reading with boundary-chain verification.

Writing: records are rows of Spark's text writer with the record separator as line end, so any
store that Spark writes to will do; equal payloads are stored once, the others as revisits. Files
hold a bounded number of records.

Reading: each task looks for the record magic in its files and emits every candidate with the
offset of its successor (end of header + Content-Length + separator). Payloads may hold the magic,
so only what is reachable from the file's start counts: candidates whose successor is the next
candidate are contracted to runs, and pointer jumping over the runs, in Spark joins, finds the
runs on the chain and where it enters them. An intact file has one run and needs no round.

Defined results: a null payload is an empty one; rows that repeat the smallest id of a payload are
all responses; null ids come back as null; a record cut off by the file's end is left out; a file
that does not start with a record gives none; no files give no rows. Line ends and percent signs
in a URL are percent-encoded in the header and decoded on reading.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoweave.session import cut_lineage, shared_folder

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: The digits of base 32 (RFC 4648) beside those of radix 32 in Spark's conv.
BASE32, RADIX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits give four of base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(h.substr(1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX32, BASE32)


def classified(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload) with payload_bytes, payload_digest, refers_to (null: a response)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("payload"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    firsts = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n"))
    firsts = firsts.filter("_n > 1").drop("_n")
    out = rows.join(firsts, "payload_digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return out.withColumn("refers_to", F.when(other, F.col("first_id"))).drop("first_id")


def write(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 1000, compression: str = "gzip") -> None:
    """Write one record per row of (page_id, url, payload)."""
    rows = classified(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


CANDIDATE = "file string, offset long, successor long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"
_URN = re.compile(r"<urn:page:(-?\d+)>")


def candidates(with_payload: bool):
    """Arrow function over (path, content): a row per place where a record may start."""

    def header(text: str) -> dict[str, str]:
        lines = (x.partition(": ") for x in text.split("\r\n")[1:])
        return {k.lower(): v for k, _, v in lines}

    def number(value: str | None) -> int | None:
        m = _URN.fullmatch(value or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in CANDIDATE.split(", "))])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                out = []
                at = data.find(MAGIC)
                while at >= 0:
                    close = data.find(b"\r\n\r\n", at)
                    fields = header(data[at:close].decode("utf-8", "replace")) if close > 0 else {}
                    length = fields.get("content-length", "")
                    if length.isdigit() and (to := close + 4 + int(length)) + 4 <= len(data) and data[to : to + 4] == b"\r\n\r\n":
                        block = data[close + 4 : to]
                        kind = fields.get("warc-type")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        found = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        n = fields.get("x-payload-length", "")
                        url = fields.get("warc-target-uri")
                        out.append((
                            path, at, to + 4, number(fields.get("warc-record-id")), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), kind,
                            number(fields.get("warc-refers-to")), int(n) if n.isdigit() else None, digest or None, kind == "revisit" or found == digest, block if with_payload else None,
                        ))
                    at = data.find(MAGIC, at + 1)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def on_chain(found: DataFrame) -> DataFrame:
    """Candidates (file, offset, successor, ...) that the chain from the file's start reaches."""
    w = Window.partitionBy("file").orderBy("offset")
    x = found.withColumn("_linked", F.coalesce(F.lag("successor").over(w) == F.col("offset"), F.lit(False)))
    x = x.withColumn("_run", F.last(F.when(~F.col("_linked"), F.col("offset")), ignorenulls=True).over(w))
    places = cut_lineage(x.select("file", "offset", "successor", "_run"))
    exits = places.groupBy("file", "_run").agg(F.max("successor").alias("offset"))
    jump = exits.join(places.select("file", "offset", F.col("_run").alias("_to")), ["file", "offset"]).select("file", "_run", "_to", F.col("offset").alias("_enter"))
    jump = cut_lineage(jump)
    reached = places.filter("offset = 0").select("file", "_run", F.col("offset").alias("_enter"))
    while jump.limit(1).count():
        far = reached.select("file", "_run").join(jump, ["file", "_run"]).select("file", F.col("_to").alias("_run"), "_enter")
        reached = cut_lineage(reached.unionByName(far).distinct())
        second = jump.select("file", F.col("_run").alias("_to"), F.col("_to").alias("_to2"), F.col("_enter").alias("_enter2"))
        jump = cut_lineage(jump.join(second, ["file", "_to"]).select("file", "_run", F.col("_to2").alias("_to"), F.col("_enter2").alias("_enter")))
    good = places.join(reached, ["file", "_run"]).filter("offset >= _enter").select("file", "offset")
    return found.join(good, ["file", "offset"])


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Verified records of the archives under ``path``; ``payload`` only if asked for."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(candidates(with_payload), CANDIDATE)
    return on_chain(found if with_payload else cut_lineage(found))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive of (page_id, url, html) to the shared folder and read it back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages.select("page_id", "url", F.col("html").alias("payload")), path, min_bytes)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


SQL = f"""with p as (select page_id, coalesce(html, '') h, url from pages), s as (select page_id, url, cast(octet_length(encode(h)) as bigint) payload_bytes, sha1(h) x from p),
 m as (select x, min(page_id) first_id from s group by x)
 select page_id, url, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda b: substr('{BASE32}', cast((cast('0x' || substr(x, cast(i * 5 + 1 as int), 5) as bigint) >> b) & 31 as int) + 1, 1)), 'string_agg', '')), 'string_agg', '') payload_digest,
 case when first_id is distinct from page_id and first_id is not null then 'revisit' else 'response' end record_type, case when first_id is distinct from page_id then first_id end refers_to, true intact from s join m using (x)"""
