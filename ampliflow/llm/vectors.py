"""Near-duplicate vectors by NN-descent.

Only vectors of one label (and length) are compared, by cosine in double
precision; vectors that are null, zero or hold null or non-finite components,
and those without a label, link with nothing. Vectors of one direction form a
class beforehand. A forest of random projections gives first neighbour lists;
a round of NN-descent refines them: all members of a vector's list and reverse
list meet. The members that links connect make a group. A list that is full of
links may lack others: a group with such a list is joined with every group
whose ball (around its least id) has one of its members within reach of a link,
so no link between them is lost. Groups are compared in blocks, in double precision.

A brute-force audit of some vectors compares all their links with those found.
While it finds less than ``RECALL``, twice as many trees follow; after
``PASSES`` all vectors of a label are compared in blocks.

Result: a row per vector: vec_id, n_links, component_id, kept. Null ids have
null components and are kept. Repeated rows count as vectors of their own. An
empty table gives no rows; only the three named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, annotate, components, numbers, runs

THRESHOLD = 0.93
NEIGHBOURS, LEAF = 10, 128
BLOCK = 2048  # members of a leaf or of a group of links compared at a time
MISSED = 1e-3  # share of pairs at the threshold that share no leaf
PASSES, RECALL = 3, 0.99
AUDITED, MOST_AUDITED, WITH_LINKS = 1024, 16384, 100
ANGLE = float(np.arccos(THRESHOLD))
SLACK = 1e-5  # of single precision


def _units(vectors: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        units, digests, dims = [], [], []
        for v in batch.column("embedding").to_pylist():
            x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
            if x is not None and len(x) and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top
                x = x / np.sqrt((x * x).sum())
                units.append(x.tobytes())
                digests.append(hashlib.blake2b(units[-1], digest_size=16).digest())
                dims.append(len(x))
            else:
                units.append(None)
                digests.append(None)
                dims.append(None)
        return {"unit": pa.array(units, pa.binary()), "digest": pa.array(digests, pa.binary()), "dim": pa.array(dims, pa.int32())}

    return annotate(vectors, [T.StructField("unit", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("dim", T.IntegerType())], run, only=["vec_id", "label"])


def _trees(bits: int, k: int) -> int:
    """Trees of pass ``k``: in those of the first, all but ``MISSED`` of the pairs at the threshold share a leaf."""
    share = (1 - ANGLE / np.pi) ** bits
    return 1 if share == 1 else int(np.ceil(np.log(MISSED) / np.log(1 - share))) << k


def _planes(dim: int, bits: int, k: int) -> np.ndarray:
    """Random directions: (trees * bits, dim), each component a sum of uniform numbers."""
    n = _trees(bits, k) * bits
    u = (numbers(n * dim * 4, 77 + k) >> np.uint64(11)).astype(np.float64) / 2**53
    return (u.reshape(-1, 4).sum(1) - 2).reshape(n, dim)


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _leaves(reps: DataFrame, k: int) -> DataFrame:
    """reps(id, space, unit, n) with (tree, leaf): n is the number of vectors of the space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            size = np.array([len(u) // 8 for u in batch.column("unit").to_pylist()])
            bits = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LEAF))).astype(int)
            for dim, b in set(zip(size.tolist(), bits.tolist(), strict=True)):
                rows = np.flatnonzero((size == dim) & (bits == b))
                part = batch.take(pa.array(rows))
                trees = _trees(b, k)
                code = np.zeros((len(rows), trees), np.int64)
                if b:
                    sides = (_matrix(part.column("unit")) @ _planes(dim, b, k).T > 0).reshape(len(rows), trees, b)
                    code = (sides * (1 << np.arange(b))).sum(2)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([part.column("space"), pa.array(np.full(len(rows), t, np.int32)), pa.array(code[:, t]), part.column("id"), part.column("unit")], names=["space", "tree", "leaf", "id", "unit"])

    return reps.select("id", "space", "unit", "n").mapInArrow(run, "space long, tree int, leaf long, id long, unit binary")


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest others of each row."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-sims, axis=1)[:, :k]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(sims, near, 1).ravel().astype(np.float32))], names=["id", "near", "sim"])


def _meet(groups: DataFrame, keys: int, k: int) -> DataFrame:
    """Neighbours found inside groups sorted by their first ``keys`` columns: (id, near, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            if len(rows) > 1:
                x = _matrix(rows["unit"]).astype(np.float32)
                yield _best(rows["id"].to_numpy(), x @ x.T, k)

    return groups.mapInArrow(run, "id long, near long, sim float")


def _lists(found: DataFrame) -> DataFrame:
    """The nearest neighbours of each vector: (id, near, sim). Ranks are limited before the shuffle by id, so a hub's lists are never in one task."""
    once = found.groupBy("id", "near").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS).drop("rank")


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(*keys, blocks, id, ...) once for each pair of blocks i <= j that ``id``'s own block x is in."""
    spread = rows.withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return spread.withColumns({"i": F.least("x", "y"), "j": F.greatest("x", "y")}).drop("y", "blocks").repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "id")


def _within_reach(members: DataFrame, lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of groups of members(group, id, space, unit) with full lists, where a member of a may link with one of b."""
    full = lists.groupBy("id").agg(F.count("*").alias("n"), F.min("sim").alias("least")).filter((F.col("n") >= NEIGHBOURS) & (F.col("least") >= THRESHOLD - SLACK))
    groups = members.join(full, "id", "left_semi").select("group").distinct()
    some = scratch.save(members.join(groups, "group", "left_semi").select("space", "group", "id", "unit"), "full")
    centres = some.filter("id = group").select("group", F.col("unit").alias("centre"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs = zip(batch.column("unit").to_pylist(), batch.column("centre").to_pylist(), strict=True)
                cos = np.array([np.dot(np.frombuffer(u), np.frombuffer(c)) for u, c in pairs])
                yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["group", "angle"])

    radius = some.join(centres, "group").select("group", "unit", "centre").mapInArrow(angles, "group long, angle double").groupBy("group").agg(F.max("angle").alias("radius"))
    balls = scratch.save(some.filter("id = group").join(radius, "group"), "balls")
    n = balls.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).alias("balls")).join(some.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "space")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = some.join(n, "space").select("space", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("i"), each("balls").alias("j"), "group", "unit", F.lit(-1.0).alias("radius"))
    asked = asked.unionByName(balls.join(n, "space").select("space", each("blocks").alias("i"), F.pmod(F.xxhash64("group"), F.col("balls")).alias("j"), "group", "unit", "radius"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            group, radius, unit = rows["group"].to_numpy(), rows["radius"].to_numpy(), _matrix(rows["unit"])
            x, c = np.flatnonzero(radius < 0), np.flatnonzero(radius >= 0)
            if len(x) and len(c):
                near = unit[x] @ unit[c].T >= np.cos(np.minimum(radius[c] + ANGLE + SLACK, np.pi))
                a, b = np.nonzero(near & (group[x][:, None] != group[c]))
                pair = np.unique(np.sort(np.stack([group[x][a], group[c][b]], 1), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return asked.repartition("space", "i", "j").sortWithinPartitions("space", "i", "j").mapInArrow(run, "a long, b long")


def _audit(reps: DataFrame, links: DataFrame) -> float:
    """Least mean share of all links of a vector that links(id, linked) holds: over audited vectors with links, and over those with few.

    More vectors are asked until WITH_LINKS with few links are among them, all are asked, or MOST_AUDITED.
    """
    total, asking = reps.count(), AUDITED
    while True:
        some = reps.orderBy(F.xxhash64("id"), "id").select("id", "space", "unit").limit(asking).toArrow()
        asked = reps.sparkSession.sparkContext.broadcast((some["id"].to_numpy(), some["space"].to_numpy(), some["unit"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, spaces, units = asked.value
            for batch in batches:
                space, own, weight = (batch.column(c).to_numpy() for c in ("space", "id", "weight"))
                for s in np.intersect1d(spaces, space):
                    rows, q = np.flatnonzero(space == s), np.flatnonzero(spaces == s)
                    x = _matrix(batch.column("unit").take(pa.array(rows)))
                    for lo in range(0, len(q), 1024):
                        part = q[lo : lo + 1024]
                        link = (np.stack([np.frombuffer(units[k]) for k in part]) @ x.T >= THRESHOLD) & (ids[part][:, None] != own[rows])
                        n, w = link.sum(1), link @ weight[rows].astype(np.float64)
                        k = np.flatnonzero(n)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][k]), pa.array(n[k]), pa.array(w[k].astype(np.int64))], names=["id", "n", "w"])

        true = reps.select("id", "space", "unit", "weight").mapInArrow(run, "id long, n long, w long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        share = F.least(F.coalesce("linked", F.lit(0)) / F.col("w"), F.lit(1.0))
        got = true.join(links, "id", "left").agg(F.avg(share).alias("all"), F.avg(F.when(F.col("n") <= NEIGHBOURS, share)).alias("few"), F.count_if(F.col("n") <= NEIGHBOURS).alias("n")).first()
        if got.n >= WITH_LINKS or asking >= min(total, MOST_AUDITED):
            return min([x for x in (got["all"], got["few"]) if x is not None], default=1.0)
        asking *= 4


def _confirm(members: DataFrame) -> DataFrame:
    """members(group, blocks, id, unit, weight): per block pair, rows (kind 0: id, weight of its links) and (kind 1: edges of a forest of links)."""
    spread = _in_blocks(members.select("group", "blocks", "id", "unit", "weight"), ["group"]).select("group", "i", "j", "x", "id", "unit", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            ids, w, x = (rows[c].to_numpy() for c in ("id", "weight", "x"))
            i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
            unit = _matrix(rows["unit"])
            link = unit @ unit.T >= THRESHOLD
            np.fill_diagonal(link, False)
            if i != j:
                link &= (x[:, None] == i) != (x == i)
            n = link @ w.astype(np.float64)
            label = np.arange(len(ids))
            while True:
                new = np.minimum(label, np.where(link, label, len(ids)).min(1, initial=len(ids)))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(k)).astype(np.int32)), pa.array(np.tile(ids[k], 2)), pa.array(np.concatenate([n[k].astype(np.int64), ids[label[k]]]))], names=["kind", "id", "value"])

    return spread.mapInArrow(run, "kind int, id long, value long")


def _search(reps: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Neighbour lists from the trees of pass ``k``."""
    leaves = scratch.save(_leaves(reps, k), f"leaves{k}")
    sizes = leaves.groupBy("space", "tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    groups = _in_blocks(leaves.join(sizes, ["space", "tree", "leaf"]), ["space", "tree", "leaf"]).select("space", "tree", "leaf", "i", "j", "id", "unit")
    return _lists(_meet(groups, 5, NEIGHBOURS))


def _refined(reps: DataFrame, found: DataFrame, old: DataFrame | None) -> DataFrame:
    """A round of NN-descent over the lists found and the old ones."""
    scratch = Scratch(reps.sparkSession)
    lists = scratch.save(_lists(found.unionByName(old)) if old is not None else found, "lists")
    back = _lists(lists.select(F.col("near").alias("id"), F.col("id").alias("near"), "sim"))
    around = lists.select("id", "near").unionByName(back.select("id", "near")).distinct().withColumnRenamed("id", "at")
    around = around.unionByName(reps.select(F.col("id").alias("at"), F.col("id").alias("near")))
    met = around.join(reps.select(F.col("id").alias("near"), "unit"), "near").select("at", F.col("near").alias("id"), "unit")
    return _lists(lists.unionByName(_meet(met.repartition("at").sortWithinPartitions("at"), 1, 4)))


def _groups(reps: DataFrame, lists: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(id, group) of the vectors that links of the lists connect, groups within reach of each other made one."""
    near = lists.filter(F.col("sim") >= THRESHOLD - SLACK).select(F.col("id").alias("a"), F.col("near").alias("b"))
    groups = components(near, scratch, f"groups{k}").withColumnRenamed("component", "group")
    reach = _within_reach(groups.join(reps.select("id", "space", "unit"), "id"), lists, scratch)
    joined = components(reach, scratch, f"joined{k}").withColumnsRenamed({"id": "group", "component": "to"})
    return groups.join(joined, "group", "left").select("id", F.coalesce("to", "group").alias("group"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``."""
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.save(_units(vectors.select("vec_id", "embedding", "label")).withColumn("space", F.xxhash64(F.col("label").cast("string"), "dim")), "units")
    good = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND digest IS NOT NULL")
    classes = scratch.save(good.groupBy("space", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    per = classes.groupBy("space").agg(F.count("*").alias("n"))
    first = good.select("space", "digest", F.col("vec_id").alias("id"), "unit").dropDuplicates(["space", "digest", "id"])
    reps = scratch.save(classes.join(first, ["space", "digest", "id"]).join(per, "space").select("id", "space", "unit", "weight", "n"), "reps")

    lists = None
    for k in range(PASSES + 1):
        if k == PASSES:  # all vectors of a space
            groups = reps.join(reps.groupBy("space").agg(F.min("id").alias("group")), "space").select("id", "group")
        else:
            lists = scratch.save(_refined(reps, _search(reps, k, scratch), lists), f"lists{k}")
            groups = _groups(reps, lists, scratch, k)
        members = scratch.save(groups.join(reps.select("id", "unit", "weight"), "id"), f"members{k}")
        blocks = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        seen = scratch.save(_confirm(members.join(blocks, "group")), f"links{k}")
        links = seen.filter("kind = 0").groupBy("id").agg(F.sum("value").alias("linked"))
        if k == PASSES or _audit(reps, links) >= RECALL:
            break
    of = components(seen.filter("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b")), scratch, "components")
    known = classes.join(links, "id", "left").join(of, "id", "left").select("space", "digest", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("of"))
    ok = rows.withColumn("digest", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("digest")))
    out = ok.join(known, ["space", "digest"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("of", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
