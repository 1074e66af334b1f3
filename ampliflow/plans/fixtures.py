"""Reads and references derived from the test tables, by the same integer rules in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import PHIX

LENGTH = 64
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 amplicons: tid, tseq."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id < 40")
    return items.select(F.col("item_id").alias("tid"), F.left(F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES), F.lit(LENGTH)).alias("tseq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, sample_id, seq, qual: amplicons with errors, unknown letters, PhiX and chimeras."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("e"), F.col("event_type").alias("sample_id"))
    e = e.repartition(spark.sparkContext.defaultParallelism)  # the table is one file of one row group
    e = e.withColumns({"tid": F.least(F.col("e") * 7919 % 40, F.col("e") * 104729 % 40, F.col("e") * 611953 % 40), "h": F.col("e") * 15485863 % 1000, "p": (1 + F.col("e") * 32452843 % LENGTH).cast("int")})
    t = F.broadcast(templates(spark, sf_dir))  # 40 rows
    e = e.join(t, "tid").join(t.select(F.pmod(F.col("tid") + 39, F.lit(40)).alias("tid"), F.col("tseq").alias("tseq2")), "tid")
    base = F.substr("tseq", F.col("p"), F.lit(1))
    put = lambda x: F.concat(F.substr("tseq", F.lit(1), F.col("p") - 1), x, F.substr("tseq", F.col("p") + 1))
    seq = F.when(F.col("h") < 250, put(F.translate(base, "ACGT", "CGTA"))).when(F.col("h") < 280, put(F.lit("N"))).when(F.col("h") < 300, PHIX[:LENGTH]).when(F.col("h") < 330, F.concat(F.left("tseq", F.lit(32)), F.substr("tseq2", F.lit(33)))).otherwise(F.col("tseq"))
    runs = ["".join(chr(53 + (r + 13 * i) % 21) for i in range(1, LENGTH + 1)) for r in range(21)]
    run = F.get(F.array(*map(F.lit, runs)), (F.col("e") * 17 % 21).cast("int"))
    qual = F.when(F.col("h") < 280, F.concat(F.substr(run, F.lit(1), F.col("p") - 1), F.lit(chr(41)), F.substr(run, F.col("p") + 1))).otherwise(run)
    return e.select(F.col("e").alias("read_id"), "sample_id", seq.alias("seq"), qual.alias("qual"), "tid", "h")


READS = f"""
t AS (SELECT item_id AS tid, left(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}'), {LENGTH}) AS tseq FROM benchmark WHERE item_id < 40),
e AS (SELECT event_id AS e, event_type AS sample_id, least((event_id * 7919) % 40, (event_id * 104729) % 40, (event_id * 611953) % 40) AS tid, (event_id * 15485863) % 1000 AS h, CAST(1 + (event_id * 32452843) % {LENGTH} AS INT) AS p FROM events),
reads AS (SELECT e AS read_id, sample_id, CASE
    WHEN h < 250 THEN left(a.tseq, p - 1) || translate(substr(a.tseq, p, 1), 'ACGT', 'CGTA') || substr(a.tseq, p + 1)
    WHEN h < 280 THEN left(a.tseq, p - 1) || 'N' || substr(a.tseq, p + 1) WHEN h < 300 THEN '{PHIX[:LENGTH]}'
    WHEN h < 330 THEN left(a.tseq, 32) || substr(b.tseq, 33) ELSE a.tseq END AS seq,
  array_to_string(list_transform(range(1, {LENGTH + 1}), lambda i: chr(CAST(33 + CASE WHEN h < 280 AND i = p THEN 8 ELSE 20 + (e * 17 + i * 13) % 21 END AS INT))), '') AS qual, e.tid AS tid, h
  FROM e JOIN t a ON e.tid = a.tid JOIN t b ON b.tid = (e.tid + 1) % 40)"""
