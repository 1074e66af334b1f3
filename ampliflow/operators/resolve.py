"""Decisions that depend on an order, taken inside the groups that pairs of sequences connect."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import align as A


def shared_path(spark: SparkSession) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names, removed when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/ampliflow-scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/saved-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written and read again, so that they are computed once."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups(pairs: DataFrame) -> DataFrame:
    """(seq, group) of the sequences that ``pairs(a, b)`` connect: the least label of neighbours, then of that label's, until nothing changes."""
    both = saved(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "b").distinct())
    label = saved(both.groupBy(F.col("a").alias("seq")).agg(F.least(F.col("seq"), F.min("b")).alias("group")))
    while True:
        near = both.join(label.withColumnRenamed("seq", "b"), "b").groupBy(F.col("a").alias("seq")).agg(F.min("group").alias("near"))
        step = label.join(near, "seq").select("seq", F.col("group").alias("old"), F.least("group", "near").alias("at"))
        far = label.select(F.col("seq").alias("at"), F.col("group").alias("far"))
        new = saved(step.join(far, "at", "left").select("seq", "old", F.least("at", F.coalesce("far", "at")).alias("group")))
        label = new.select("seq", "group")
        if new.filter("old <> group").isEmpty():
            return label


def _homes(pdf: pd.DataFrame) -> pd.DataFrame:
    """In descending totals, a sequence enters the first home that holds it or that it holds; the longest one names the home."""
    pdf = pdf.sort_values(["total", "seq"], ascending=[False, True])
    names: list[str] = []
    at = []
    for s in pdf["seq"]:
        k = next((k for k, name in enumerate(names) if s in name or name in s), len(names))
        if k == len(names):
            names.append(s)
        elif len(s) > len(names[k]):
            names[k] = s
        at.append(k)
    return pd.DataFrame({"seq": pdf["seq"], "to": [names[k] for k in at]})


def homes(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, to) of the sequences that ``pairs(a, b)`` connect by one being part of the other."""
    return totals.join(groups(pairs), "seq").groupBy("group").applyInPandas(_homes, "seq string, to string")


def _shifts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of edges (rank of a, a, b), b before a: whether a is the shift of one that is none itself."""
    flag: dict[str, bool] = {}
    for a, others in pdf.sort_values(["rank", "a"]).groupby("a", sort=False)["b"]:
        flag[a] = not all(flag.get(b, False) for b in others)
    return pd.DataFrame({"seq": list(flag), "is_shift": list(flag.values())})


def shifts(uniques: DataFrame, min_overlap: int = 20) -> DataFrame:
    """uniques(seq, abundance) with is_shift: an exact end overlap of ``min_overlap`` letters or more with a more abundant one that is no shift itself.

    Candidates share a start of ``min_overlap`` letters of one of the two; they are aligned. Ties of abundance go to the lesser sequence.
    """
    n = uniques.groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    long = n.filter(F.length("seq") >= min_overlap)
    words = F.transform(F.sequence(F.lit(1), F.length("seq") - min_overlap + 1), lambda i: F.substr("seq", i, F.lit(min_overlap)))
    held = long.select(F.col("seq").alias("holder"), F.explode(F.array_distinct(words)).alias("word"))
    near = long.select("seq", F.left("seq", F.lit(min_overlap)).alias("word")).join(held, "word").filter("seq <> holder").select(F.least("seq", "holder").alias("x"), F.greatest("seq", "holder").alias("y")).distinct()

    def run(batches):
        for pdf in batches:
            made = [A.evaluate(*m) for m in A.align(list(zip(pdf["x"], pdf["y"], strict=True)))]
            size = [min(len(x), len(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf[[min_overlap <= same < k and not other and not gaps for (same, other, gaps), k in zip(made, size, strict=True)]]

    near = near.mapInPandas(run, "x string, y string")
    rank = lambda c: n.select(F.col("seq").alias(c), F.struct(-F.col("abundance"), F.col("seq")).alias(f"r{c}"))
    ranked = near.join(rank("x"), "x").join(rank("y"), "y")
    later = F.col("rx") > F.col("ry")
    edges = saved(ranked.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("b")))
    order = n.select(F.col("seq").alias("a"), (-F.col("abundance")).alias("rank"))
    grouped = edges.join(groups(edges).withColumnRenamed("seq", "a"), "a").join(order, "a")
    flags = grouped.groupBy("group").applyInPandas(_shifts, "seq string, is_shift boolean")
    return n.join(flags, "seq", "left").withColumn("is_shift", F.coalesce("is_shift", F.lit(False)))
