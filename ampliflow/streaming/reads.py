"""Reads as streams: filters are stateless, dereplication keeps a count for each sample and sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reads import filter_reads


def filter_stream(reads: DataFrame, **options) -> DataFrame:
    """The single-end filter; works on streams (append mode) and tables alike."""
    return filter_reads(reads, **options)


def uniques_stream(reads: DataFrame) -> DataFrame:
    """Counts of the sequences of each sample so far (update or complete mode)."""
    return reads.groupBy("sample_id", F.upper("seq").alias("seq")).agg(F.count("*").alias("abundance"))
