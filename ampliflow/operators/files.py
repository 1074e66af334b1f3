"""Reads from FASTQ files to FASTQ files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sequences import file_samples, register
from . import reads as R

PARTS = ("header", "seq", "qual")


def _write(reads: DataFrame, path: str, samples: list[str], compress: bool) -> None:
    rows = reads.withColumn("sep", F.lit("+")).repartition("sample_id").sortWithinPartitions("sample_id", "read_id")
    rows.write.format("fastq").options(bySample="true", samples=",".join(samples), compression="gzip" if compress else "none").mode("overwrite").save(path)


def filter_and_trim(spark: SparkSession, fwd: str, filt: str, rev: str | None = None, filt_rev: str | None = None, compress: bool = True, orient: str | None = None, **options) -> DataFrame:
    """Write the reads (of pairs: both mates, or none) that pass, a file for each sample; returns sample_id, reads_in, reads_out.

    Options are those of ``filter_reads``; a tuple has one value for each mate. A sample without reads left gets an empty file.
    Mates belong together by their places in files of the same rank by name; samples are named by the forward files.
    """
    if (not rev) != (not filt_rev):
        raise ValueError("reverse reads need an input and an output")
    register(spark)
    side = lambda k: {name: v[k] if isinstance(v, tuple) else v for name, v in options.items()}
    reads, names = spark.read.format("fastq").load(fwd), file_samples(fwd)
    if not rev:
        kept = R.filter_reads(reads, orient=orient, **side(0))
        _write(kept.select("sample_id", "read_id", *PARTS), filt, names, compress)
        return R.filter_stats(reads, kept)
    mates, other = spark.read.format("fastq").load(rev), file_samples(rev)
    if len(names) != len(other):
        raise ValueError("as many forward as reverse files are needed")
    named = F.broadcast(spark.createDataFrame(list(zip(names, other, strict=True)), "sample_id string, other string"))  # a row a file
    mates = mates.withColumnRenamed("sample_id", "other").join(named, "other").drop("other")
    kept = R.filter_pairs(reads, mates, side(0), side(1), orient=orient)
    _write(kept.select("sample_id", "read_id", *[F.col(f"f_{c}").alias(c) for c in PARTS]), filt, names, compress)
    back = kept.join(named, "sample_id").select(F.col("other").alias("sample_id"), "read_id", *[F.col(f"r_{c}").alias(c) for c in PARTS])
    _write(back, filt_rev, other, compress)
    return R.filter_stats(reads, kept)
