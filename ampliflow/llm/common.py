"""Helpers shared by the training-data operators.

Text kernels work on the UTF-8 bytes of Arrow string columns with numpy, in
slices of bounded size, so that a task's memory does not depend on the length
of its partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20  # text handled at a time by a kernel (one longer text makes a slice of its own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables that cut lineage, in the folder all executors share (``spark.checkpoint.dir``); removed when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.gettempdir() + "/ampliflow-scratch"
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        path, files = self._path("")
        files.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)


def annotate(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], dict], only: list[str] | None = None) -> DataFrame:
    """Add columns computed from each Arrow batch; input columns of the same names give way.

    ``fn`` gets a batch and returns the new columns by name. ``only`` keeps just those input columns.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (only is None or f.name in only)]
    names = [f.name for f in kept]
    out = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [made[f.name] for f in fields], names=names + [f.name for f in fields])

    return df.mapInArrow(run, out)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes (one row at least)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_table(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words split by white space, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
WORD = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def words(data: np.ndarray, off: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, none across texts, and the first run of each text (and their number)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kept[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = numbers(256, 1)
_STEP = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64))
_LEAP = np.uint64(_STEP[-1])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that follow each other without overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(first, size)
    at = pos + np.repeat(start, size)
    value = _BYTE[data[at]] * _STEP[pos & 4095]
    if size.max() > 4096:
        value = value * np.cumprod(np.full(int(size.max() >> 12) + 1, _LEAP, np.uint64))[pos >> 12]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        cut = (np.flatnonzero(np.any([v[1:] != v[:-1] for v in value], axis=0)) + 1).tolist()
        if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


FOREST_EDGES = 2_000_000  # edges (16 bytes each) that one task may hold to finish a forest


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of a partition: each node with the least of its component. Roots hook onto lesser neighbours, then paths are halved."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not held:
        return
    nodes, code = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = code.reshape(2, -1)
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, two := up[up]):
            up = two
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str, most: int = FOREST_EDGES) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (id, component), component the smallest id. Ids without an edge may be left out.

    While there are more than ``most`` edges, they are contracted: each node
    points to the neighbour (or itself) of least pseudo-random rank in this
    round, edges are renamed to what their ends point to. The number of nodes
    falls geometrically for any order of the ids, and hubs only pass through
    partial aggregates. A graph of at most ``most`` edges is finished by
    union-find in one task.
    """
    now = scratch.save(edges.filter("a <> b").select("a", "b"), f"{name}-edges0")
    labels, k = None, 0
    while (n := now.count()) > most:
        k += 1
        rank = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("rank"), c.alias("id"))
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("best"))
        to = scratch.save(to.select("node", F.least("best", rank(F.col("node")))["id"].alias("to")), f"{name}-to{k}")
        renamed = now.join(to.withColumnsRenamed({"node": "a", "to": "a2"}), "a").join(to.withColumnsRenamed({"node": "b", "to": "b2"}), "b")
        now = scratch.save(renamed.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct(), f"{name}-edges{k}")
        moved = to.withColumnsRenamed({"node": "id", "to": "at"}) if labels is None else labels.join(to.withColumnRenamed("node", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at"))
        labels = scratch.save(moved, f"{name}-labels{k}")
        scratch.drop(f"{name}-edges{k - 1}", f"{name}-labels{k - 1}")
    last = now.coalesce(1).mapInArrow(_forest, "a long, b long") if n else now
    last = scratch.save(last.withColumnsRenamed({"a": "id", "b": "component"}), f"{name}-forest")
    if labels is None:
        return last
    merged = labels.join(last.withColumnRenamed("id", "at"), "at", "left").select("id", F.coalesce("component", "at").alias("root"))
    least = merged.groupBy("root").agg(F.min("id").alias("component"))
    return scratch.save(merged.join(least, "root").select("id", "component"), f"{name}-components")
