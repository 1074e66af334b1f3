"""Near-duplicate documents by circulant MinHash.

Shingles are placed in a universe of 2^20 by a first permutation; a second
permutation, shifted circularly by 1..252, gives all signature coordinates
(a shingle's coordinates are one contiguous slice of it). 42 bands of 6
coordinates make pairs of Jaccard similarity 0.8 meet with a probability above
0.999997. Documents of one shingle set form a class beforehand.

Instead of all pairs of a bucket, its smallest document is compared with the
others on full shingle sets. In buckets that then still hold several
components, all their members are compared, block against block of the groups
that such buckets connect: pairs of different components whose signatures
agree in at least ``LIKELY`` coordinates (six standard deviations below the
mean of the weakest link) are compared on full sets. So no pair that met in a
bucket goes without a decision, and only links leave a task.

Link: ``den * |A and B| >= num * |A or B|``. No word or null text: empty set,
linked with nothing. Fewer words than a shingle: all of them make one.
Repeated rows fall into one class. Rows of one ``doc_id`` make one document:
it is linked if any of its texts is. A null id is linked with nothing. An empty
table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, Scratch, annotate, components, mix, numbers, runs, slices, text_buffers, word_hashes, words

UNIVERSE_BITS = 20
BANDS, ROWS = 42, 6
LIKELY = 164  # of 252 coordinates
BLOCK = 2 << 20  # shingles of a block
FEW, SMALL = 8, 1 << 15  # blocks into which smaller groups are split, if these have as many shingles
BROADCAST_IDS = 2_000_000  # ids (8 bytes each) up to which the documents to compare are marked by broadcast

_made: dict[str, np.ndarray] = {}


def _permutation(seed: int) -> np.ndarray:
    return np.argsort(numbers(1 << UNIVERSE_BITS, seed), kind="stable").astype(np.uint32)


def _circulant() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the slices of the second, one for each place."""
    if not _made:
        second = _permutation(12)
        k = BANDS * ROWS
        _made["first"] = _permutation(11)
        _made["second"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([second[-k:], second]), k)
    return _made["first"], _made["second"]


def signature(shingles: np.ndarray) -> np.ndarray:
    first, second = _circulant()
    at = first[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    least = second[at[:2048]].min(axis=0)
    for lo in range(2048, len(at), 2048):
        least = np.minimum(least, second[at[lo : lo + 2048]].min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part = least.reshape(BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = mix(key + part[:, r] * np.uint64(0xD1342543DE82EF95))
    return key.view(np.int64)


def shingle_sets(col: pa.Array, ngram: int):
    """The sorted distinct shingle hashes of each text."""
    data, off = text_buffers(col)
    for lo, hi in slices(off):
        part = LOWER[data[off[lo] : off[hi]]]
        start, end, first = words(part, off[lo : hi + 1] - off[lo], NOT_SPACE)
        hashes = word_hashes(part, start, end)
        run = np.zeros(len(hashes), np.uint64)
        for k in range(ngram):
            rest = len(hashes) - k
            if rest > 0:
                run[:rest] = mix(run[:rest] + hashes[k:] + np.uint64(k + 1))
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= ngram:
                yield np.unique(run[a : b - ngram + 1])
            elif b > a:
                value = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    value = mix(value + h) + np.uint64(b - a)
                yield mix(value)
            else:
                yield run[:0]


def _features(docs: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n, digests, keys = [], [], []
        for s in shingle_sets(batch.column("text"), ngram):
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(band_keys(signature(s)) if len(s) else None)
        return {"n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))}

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fields, run, only=["doc_id"])


def _sets(ids: DataFrame, docs: DataFrame, ngram: int, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, shingles, sign) of the documents of ``ids(doc_id)``, each distinct set once."""
    marked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batch: pa.RecordBatch) -> dict:
        sets = list(shingle_sets(batch.column("text"), ngram))
        return {"shingles": pa.array([s.tobytes() for s in sets], pa.binary()), "sign": pa.array([signature(s).astype(np.uint8).tobytes() if len(s) else b"" for s in sets], pa.binary())}

    sets = annotate(docs.join(marked, "doc_id", "left_semi"), [T.StructField("shingles", T.BinaryType()), T.StructField("sign", T.BinaryType())], run, only=["doc_id"])
    return scratch.save(sets.filter("length(sign) > 0").dropDuplicates(["doc_id", "shingles"]), f"{name}-sets")


def _linked(pairs: DataFrame, docs: DataFrame, ngram: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of ``pairs(a, b)`` of which some texts link, compared on the full shingle sets of ``docs(doc_id, text)``."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = _sets(ids, docs, ngram, scratch, name)

    def compare(batch: pa.RecordBatch) -> dict:
        out = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            if not len(x):
                out.append(False)
                continue
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out.append(den * both >= num * (len(x) + len(y) - both))
        return {"link": pa.array(out, pa.bool_())}

    a, b = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = annotate(pairs.join(a, "a").join(b, "b"), [T.StructField("link", T.BooleanType())], compare, only=["a", "b"])
    found = scratch.save(both.filter("link").select("a", "b").distinct(), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-ids")
    return found


def _between(rows: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of different components of two blocks (or one)."""
    of, ids, x = (rows[c].to_numpy() for c in ("of", "b", "x"))
    signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(len(ids), -1)
    sets = [np.frombuffer(v, np.uint64) for v in rows["shingles"].to_pylist()]
    n = size = np.array([len(v) for v in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(size) - size
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    right = np.flatnonzero(x == j)
    found = []
    for a in np.flatnonzero(x == i).tolist():
        r = right[right > a] if i == j else right
        r = r[(of[r] != of[a]) & (den * np.minimum(n[a], n[r]) >= num * np.maximum(n[a], n[r]))]
        r = r[(signs[r] == signs[a]).sum(1) >= LIKELY]
        if len(r):
            own = code[at[a] : at[a] + size[a]]
            mark[own] = True
            first = np.cumsum(size[r]) - size[r]
            both = np.add.reduceat(mark[code[np.arange(int(size[r].sum())) + np.repeat(at[r] - first, size[r])]].astype(np.int64), first)
            mark[own] = False
            found += [(ids[a], b) for b in ids[r[den * both >= num * (size[a] + size[r] - both)]].tolist()]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs.min(1, initial=1 << 62), pairs.max(1, initial=-(1 << 62))


def _apart(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of ``members(group, blocks, of, b, sign, shingles)`` between different components of a group."""
    spread = members.withColumn("x", F.pmod(F.xxhash64("b"), F.col("blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("group", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "of", "b", "sign", "shingles")

    def run(batches):
        for rows in runs(batches, 3):
            a, b = _between(rows, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return spread.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    feats = scratch.save(_features(docs, id_col, text_col, ngram), "features")
    some = feats.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.save(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes, (some.digest == classes.digest) & (some.doc_id == classes.rep), "left_semi")
    keyed = scratch.save(reps.select("doc_id", "n_shingles", F.explode("keys").alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("p"), F.max("doc_id").alias("last")).filter("p.doc_id <> last")
    mates = keyed.join(shared.select("key", F.col("p.doc_id").alias("a"), F.col("p.n_shingles").alias("na")), "key").select("key", "a", "na", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"))
    mates = scratch.save(mates, "mates")
    scratch.drop("keyed")
    alike = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    pairs = mates.filter((F.col("a") != F.col("b")) & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _linked(scratch.save(pairs, "pairs"), texts, ngram, num, den, scratch, "star")
    again = some.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")  # ids of several texts
    own = some.join(again, "doc_id", "left_semi").join(classes, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(own), scratch, "star-components")

    now = mates.select("key", "b", "nb").join(found.withColumnRenamed("id", "b"), "b", "left").withColumn("of", F.coalesce("component", "b")).drop("component")
    now = scratch.save(now, "bucket-components")
    several = now.groupBy("key").agg(F.min("of").alias("first"), F.max("of").alias("last"), F.min("b").alias("a")).filter("first <> last")
    open_ = scratch.save(now.join(several.select("key", "a"), "key").select("a", "b", "of", "nb"), "open")
    if not open_.isEmpty():
        groups = components(open_.select("a", "b"), scratch, "groups").withColumnsRenamed({"id": "b", "component": "group"})
        members = open_.groupBy("b").agg(F.min("of").alias("of"), F.max("nb").alias("nb")).join(groups, "b", "left").withColumn("group", F.coalesce("group", "b"))
        members = scratch.save(members, "members")
        blocks = members.groupBy("group").agg(F.greatest(F.ceil(F.sum("nb") / BLOCK), F.least(F.lit(FEW), F.ceil(F.sum("nb") / SMALL))).alias("blocks"))
        sets = _sets(members.select(F.col("b").alias("doc_id")), texts, ngram, scratch, "members").withColumnRenamed("doc_id", "b")
        more = scratch.save(_apart(members.join(blocks, "group").join(sets, "b"), num, den), "apart")
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "all-components")
    of = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("of"))
    out = feats.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
