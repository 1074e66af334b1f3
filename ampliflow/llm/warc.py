"""Merkle fixity audit of archives.

Records (file, offset, length, digest) are hashed into trees: a leaf covers a
fixed range of offsets of a file, a node above it a fixed number of ranges, so
any record's place follows from its offset and no file is audited in one task.
Two replicas are compared from the roots down: only children of nodes that
differ are joined, and only records of leaves that differ are compared.

``archive`` frames pages as WARC records of files of ``FILE_PAGES`` page ids;
``read_warc`` takes the records of existing WARC files (plain or gzipped), so
that any two copies can be audited.

Statuses: ``corrupt`` (other length or digest), ``missing`` (not in the
replica), ``extra`` (only there). Repeated records of one offset are compared
as a sorted list. Null fields are empty; pages of a null id go to negative
files by their digest. Empty tables give no rows; only named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

RANGE, FANOUT, LEVELS = 1 << 16, 16, 4
FILE_PAGES = 1000
NULL_FILES = 4  # hex digits of the digest that name the file of a page without an id


def archive(pages: DataFrame) -> DataFrame:
    """``pages`` as WARC records of archive files: file, offset, length, digest (of the framed record), page_id (-1: null)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    name = F.sha2(F.concat(url, F.lit("\n"), html), 256)
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), name, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"))
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    rows = pages.select("page_id", record.alias("record")).select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    file = F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), -1 - F.conv(F.left("digest", F.lit(NULL_FILES)), 16, 10).cast("long"))
    rows = rows.select(file.cast("long").alias("file"), F.coalesce("page_id", F.lit(-1)).alias("page_id"), "length", "digest")
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def warc_records(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, digest, record id) of the records of a WARC file, of its bytes after decompression.

    What has no valid head or is cut off runs to the next ``WARC/`` line, or the end, as a record without an id.
    """
    at = 0
    while at < len(data):
        stop, name = data.find(b"\r\n\r\n", at), ""
        end = -1
        if data.startswith(b"WARC/", at) and stop >= 0:
            fields = dict(x.split(b":", 1) for x in data[at:stop].split(b"\r\n")[1:] if b":" in x)
            fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
            if (size := fields.get(b"content-length", b"")).isdigit() and stop + 8 + int(size) <= len(data):
                end, name = stop + 8 + int(size), fields.get(b"warc-record-id", b"").decode("utf-8", "replace")
        if end < 0:
            end = data.find(b"\r\nWARC/", at + 1)
            end = len(data) if end < 0 else end + 2
        yield at, end - at, hashlib.sha256(data[at:end]).hexdigest(), name
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files of a folder or pattern (each of at most 2 GB): file (name), offset, length, digest, page_id (record id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
                found = list(warc_records(data))
                for lo in range(0, len(found), 10_000):
                    offset, length, digest, ids = zip(*found[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(offset)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(digest), pa.array(ids)], names=["file", "offset", "length", "digest", "page_id"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, offset long, length long, digest string, page_id string")


def tree(records: DataFrame, scratch: Scratch, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (file, node, hash) of each level, leaves first."""
    said = F.concat_ws(":", "offset", "length", "digest")
    leaf = records.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(said)), ","), 256).alias("hash"))
    made = [scratch.save(leaf, f"{name}-0")]
    for k in range(1, levels + 1):
        part = F.struct("node", "hash")
        up = made[-1].groupBy("file", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(part)).alias("of"))
        up = up.select("file", F.col("up").alias("node"), F.sha2(F.array_join(F.transform("of", lambda x: F.concat_ws(":", x["node"], x["hash"])), ","), 256).alias("hash"))
        made.append(scratch.save(up, f"{name}-{k}"))
    return made


def audit(records: DataFrame, replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Records that differ: file, offset, status, length, digest, page_id, replica_digest, root, replica_root."""
    scratch = Scratch(records.sparkSession)
    records, replica = scratch.save(records, "records"), scratch.save(replica, "replica")  # each is read three times
    last = records.select("offset").unionByName(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    while FANOUT**levels <= last // RANGE:
        levels += 1
    ours, theirs = tree(records, scratch, "ours", levels), tree(replica, scratch, "theirs", levels)
    bad = None
    for k in range(levels, -1, -1):
        a, b = ours[k], theirs[k].withColumnRenamed("hash", "other")
        if bad is not None:
            under = bad.withColumnRenamed("node", "up").select("file", "up")
            a, b = (x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(under, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        found = a.join(b, ["file", "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("other")))
        bad = scratch.save(found, f"bad-{k}")
        if k == levels:
            roots = bad.select("file", F.col("hash").alias("root"), F.col("other").alias("replica_root"))
    place = F.floor(F.col("offset") / RANGE)
    a, b = (x.withColumn("node", place).join(bad.select("file", "node"), ["file", "node"], "left_semi").groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("length", "digest", "page_id"))).alias(c)) for x, c in ((records, "a"), (replica, "b")))
    same = F.transform("a", lambda x: F.concat_ws(":", x["length"], x["digest"])).eqNullSafe(F.transform("b", lambda x: F.concat_ws(":", x["length"], x["digest"])))
    found = a.join(b, ["file", "offset"], "full_outer").filter(~same)
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    one = F.coalesce(F.get("a", F.lit(0)), F.get("b", F.lit(0)))
    found = found.select("file", "offset", status.alias("status"), one["length"].alias("length"), F.get("a", F.lit(0))["digest"].alias("digest"), one["page_id"].alias("page_id"), F.get("b", F.lit(0))["digest"].alias("replica_digest"))
    return found.join(roots, "file")


def damaged(pages: DataFrame) -> DataFrame:
    """The records of a replica in which the first byte of some pages has rotted and some records are gone."""
    page = F.coalesce("page_id", F.lit(-1))
    rotten = pages.withColumn("html", F.when((F.pmod(page, F.lit(97)) == 5) & F.startswith("html", F.lit("<")), F.concat(F.lit("["), F.substr("html", F.lit(2)))).otherwise(F.col("html")))
    return archive(rotten).filter(F.pmod("page_id", F.lit(211)) != 7)
