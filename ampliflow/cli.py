"""Command line: ``python -m ampliflow.cli filter-trim IN OUT [REVERSE_IN REVERSE_OUT] ...`` and ``assign-taxonomy QUERIES REFERENCE OUT ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import tables as T
from .operators.files import filter_and_trim
from .sources.sequences import register


def filter_trim(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write filtered reads (of pairs: both mates, or none) as FASTQ by sample, and sample, reads_in, reads_out, pct_retained as TSV.

    A sample without reads left gets an empty file. Mates belong together by their places in files of the same rank by name.
    """
    options = dict(trim_left=a.trim_left, trim_right=a.trim_right, trunc_len=(a.trunc_len, a.trunc_len_reverse), trunc_q=a.trunc_q, min_len=a.min_len, max_n=a.max_n, max_ee=a.max_ee, rm_phix=not a.keep_phix)
    try:
        stats = filter_and_trim(spark, a.input, a.output, a.reverse, a.reverse_output, compress=not a.plain, **options)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    stats = stats.withColumn("pct_retained", F.round(100 * F.col("reads_out") / F.col("reads_in"), 1)).withColumnRenamed("sample_id", "sample")
    stats.write.mode("overwrite").csv(f"{a.output}_stats", sep="\t", header=True)


def _asked(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a FASTA, Parquet or CSV file (column ``sequence`` or ``seq``)."""
    if path.endswith((".parquet", ".csv")):
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
        return df.select(F.upper("sequence" if "sequence" in df.columns else "seq").alias("seq")).distinct()
    return spark.read.format("fasta").load(path).select("seq").distinct()


def assign_taxonomy(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write for each query the names of its ranks and their bootstraps as TSV; ranks below ``--min-boot`` are null."""
    refs = spark.read.format("fasta").load(a.reference)
    levels = tuple(a.levels.split(","))
    named = T.assign_taxonomy(_asked(spark, a.queries), refs, levels, a.min_boot, a.try_rc, a.rounds)
    named.withColumnRenamed("seq", "sequence").write.mode("overwrite").csv(a.output, sep="\t", header=True)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ampliflow")
    p.add_argument("--version", action="version", version=f"ampliflow {__version__}")
    sub = p.add_subparsers(required=True)
    f = sub.add_parser("filter-trim")
    f.add_argument("input")
    f.add_argument("output")
    f.add_argument("reverse", nargs="?")
    f.add_argument("reverse_output", nargs="?")
    for name, kind, default in (("trim-left", int, 0), ("trim-right", int, 0), ("trunc-len", int, 0), ("trunc-len-reverse", int, 0), ("trunc-q", int, None), ("min-len", int, 20), ("max-n", int, 0), ("max-ee", float, float("inf"))):
        f.add_argument(f"--{name}", type=kind, default=default)
    f.add_argument("--keep-phix", action="store_true")
    f.add_argument("--plain", action="store_true", help="do not compress")
    f.set_defaults(run=filter_trim)
    t = sub.add_parser("assign-taxonomy")
    for name in ("queries", "reference", "output"):
        t.add_argument(name)
    t.add_argument("--min-boot", type=int, default=50)
    t.add_argument("--rounds", type=int, default=100)
    t.add_argument("--levels", default=",".join(T.LEVELS))
    t.add_argument("--try-rc", action="store_true")
    t.set_defaults(run=assign_taxonomy)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    register(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
