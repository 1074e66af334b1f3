"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Language identification (what it cannot tell goes), near-duplicates (one
document of each group stays), benchmark decontamination (contaminated
documents go), personal data (replaced by its kind), packing (the pieces of
training sequences). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.llm.common import Scratch, table
from ampliflow.llm.decontaminate import decontaminate
from ampliflow.llm.language import fit, held_out, identify
from ampliflow.llm.minhash import BROADCAST_IDS, near_duplicates
from ampliflow.llm.pack import pack
from ampliflow.llm.pii import find_pii, redact

LEAST_SCORE = 0.35  # of a language, below which a document is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a known language: not ``und``, and of a score of LEAST_SCORE at least."""
    net = fit(docs.filter(~held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify(docs, net).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates (five-word shingles, similarity 0.8), and one row of repeated ids."""
    scratch = Scratch(spark)
    found = scratch.save(near_duplicates(docs).select("doc_id", "kept"), "found")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = scratch.save(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return left
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a whole window (13 words) of the benchmark, and with less than a twentieth of their words from shorter items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated") & (F.col("n_whole") == 0)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kinds; n_chars follows."""
    clean = redact(find_pii(docs))
    return clean.withColumn("n_chars", F.when(F.size("span_list") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None  # language, links and tokens are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before has written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
