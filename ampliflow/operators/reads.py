"""Read filters, dereplication and quality profiles: DataFrame in, DataFrame out.

Reads are rows (sample_id, read_id, seq, qual); all steps are built-in
expressions, so filters stay inside code generation and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S


def oriented(df: DataFrame, start: str, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Reads that begin with ``start``, turned if only their reverse complement does; others go. Adds ``turned``."""
    s, q = F.col(seq), F.col(qual)
    ahead, behind = s.startswith(start), S.rc(s).startswith(start)
    return df.filter(ahead | behind).withColumns({"turned": ~ahead, seq: F.when(ahead, s).otherwise(S.rc(s)), qual: F.when(ahead, q).otherwise(F.reverse(q))})


def trimmed(seq: Column, qual: Column, trim_left: int = 0, trim_right: int = 0, trunc_len: int = 0, trunc_q: int | None = None) -> tuple[Column, Column]:
    """Cut at the first quality of ``trunc_q`` or less, trim both ends, truncate."""
    n = F.length(qual)
    if trunc_q is not None:
        n = F.length(F.regexp_extract(qual, f"^[^!-\\x{33 + trunc_q:02x}]*", 0))
    stop = n - trim_right
    if trunc_len:
        stop = F.least(stop, F.lit(trim_left + trunc_len))
    size = F.greatest(stop - trim_left, F.lit(0))
    return F.substr(seq, F.lit(trim_left + 1), size), F.substr(qual, F.lit(trim_left + 1), size)


def passes(seq: Column, qual: Column, trunc_len: int = 0, min_len: int = 20, max_n: int = 0, min_q: int = 0, max_ee: float = float("inf"), rm_phix: bool = True, rm_lowcomplex: float = 0) -> Column:
    """Cheap tests first."""
    ok = F.length(seq) >= max(min_len, trunc_len)
    if max_n >= 0:
        ok &= S.count_non_acgt(seq) <= max_n
    if min_q > 0:
        ok &= ~qual.rlike(f"[!-\\x{32 + min_q:02x}]")
    if max_ee != float("inf"):
        ok &= F.round(S.expected_errors(qual), 9) <= max_ee
    if rm_phix:
        ok &= S.phix_hits(seq) < 2
    if rm_lowcomplex > 0:
        ok &= S.complexity(seq) >= rm_lowcomplex
    return ok


_TRIM = ("trim_left", "trim_right", "trunc_len", "trunc_q")


def filter_reads(df: DataFrame, *, max_len: int = 0, orient: str | None = None, **options) -> DataFrame:
    """Single-end filter: orient, longest length, truncation and trimming, then the tests of ``passes``."""
    df = oriented(df, orient).drop("turned") if orient else df
    df = df.filter(F.length("seq") <= max_len) if max_len else df
    seq, qual = trimmed(F.col("seq"), F.col("qual"), **{k: v for k, v in options.items() if k in _TRIM})
    df = df.withColumns({"seq": seq, "qual": qual})
    return df.filter(passes(F.col("seq"), F.col("qual"), **{k: v for k, v in options.items() if k not in _TRIM or k == "trunc_len"}))


def filter_pairs(fwd: DataFrame, rev: DataFrame, fwd_options: dict | None = None, rev_options: dict | None = None, orient: str | None = None) -> DataFrame:
    """Paired filter: a pair stays if both mates do. A mate without the other is an error.

    Headers are kept where both have them. Options of a side are those of ``filter_reads``. With ``orient`` forward reads must begin with it; where only the reverse
    complement does, both mates are turned.
    """
    both = fwd.alias("f").join(rev.alias("r"), ["sample_id", "read_id"], "full_outer")
    whole = F.when(F.col("f.seq").isNull() | F.col("r.seq").isNull(), F.raise_error(F.lit("forward and reverse reads differ"))).otherwise(F.lit(True))
    carried = ("header", "seq", "qual") if "header" in fwd.columns and "header" in rev.columns else ("seq", "qual")
    out = both.filter(whole).select("sample_id", "read_id", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "fr" for c in carried])
    if orient:
        ahead, behind = F.col("f_seq").startswith(orient), S.rc(F.col("f_seq")).startswith(orient)
        turned = {f"{x}_seq": F.when(ahead, F.col(f"{x}_seq")).otherwise(S.rc(F.col(f"{x}_seq"))) for x in "fr"} | {f"{x}_qual": F.when(ahead, F.col(f"{x}_qual")).otherwise(F.reverse(f"{x}_qual")) for x in "fr"}
        out = out.filter(ahead | behind).withColumns(turned)
    sides = (("f", fwd_options or {}), ("r", rev_options or {}))
    columns = {}
    for side, options in sides:
        if most := options.get("max_len", 0):
            out = out.filter(F.length(f"{side}_seq") <= most)
        seq, qual = trimmed(F.col(f"{side}_seq"), F.col(f"{side}_qual"), **{k: v for k, v in options.items() if k in _TRIM})
        columns |= {f"{side}_seq": seq, f"{side}_qual": qual}
    out = out.withColumns(columns)
    for side, options in sides:
        out = out.filter(passes(F.col(f"{side}_seq"), F.col(f"{side}_qual"), **{k: v for k, v in options.items() if k not in (*_TRIM, "max_len") or k == "trunc_len"}))
    return out


def cycled(seed: DataFrame, bases: int) -> DataFrame:
    """The reads of a small table in turn (by read_id), numbered anew, until ``bases`` letters are reached."""
    order = Window.orderBy("read_id")
    place = seed.select("*", (F.row_number().over(order) - 1).alias("k"), F.sum(F.length("seq")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    size = seed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases")).first()
    if not size.bases:
        return seed
    rounds = seed.sparkSession.range(-(-bases // size.bases)).withColumnRenamed("id", "c")
    some = rounds.join(F.broadcast(place)).filter(F.col("c") * size.bases + F.col("upto") - F.length("seq") < bases)
    return some.withColumn("read_id", F.col("c") * size.n + F.col("k")).select(*seed.columns)


def filter_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reads in and out of each sample; samples without any left have 0."""
    n = before.groupBy("sample_id").agg(F.count("*").alias("reads_in"))
    m = after.groupBy("sample_id").agg(F.count("*").alias("reads_out"))
    return n.join(m, "sample_id", "left").select("sample_id", "reads_in", F.coalesce("reads_out", F.lit(0).cast("long")).alias("reads_out"))


def remove_primers(df: DataFrame, forward: str, reverse: str | None = None, max_mismatch: int = 2, trim_forward: bool = True, trim_reverse: bool = True, orient: bool = True) -> DataFrame:
    """Reads with the primers at their ends within a Hamming distance, as read or turned; trimmed."""
    n, m = len(forward), len(reverse or "")

    def fits(s: Column) -> Column:
        ok = (F.length(s) >= max(n, m)) & (S.hamming(F.left(s, F.lit(n)), F.lit(forward)) <= max_mismatch)
        return ok & (S.hamming(F.right(s, F.lit(m)), S.rc(F.lit(reverse))) <= max_mismatch) if reverse else ok

    s, q = F.col("seq"), F.col("qual")
    ahead, behind = fits(s), fits(S.rc(s)) if orient else F.lit(False)
    df = df.filter(ahead | behind).withColumns({"seq": F.when(ahead, s).otherwise(S.rc(s)), "qual": F.when(ahead, q).otherwise(F.reverse(q))})
    lo, hi = n if trim_forward else 0, F.length("seq") - (m if reverse and trim_reverse else 0)
    df = df.filter(hi > lo)
    return df.withColumns({c: F.substr(F.col(c), F.lit(lo + 1), hi - lo) for c in ("seq", "qual")})


def _quality_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sample_id, seq, n, sums) of the sequences of each batch of (sample_id, seq, qual) or of such rows."""
    for batch in batches:
        pdf = batch.to_pandas()
        code, first = pd.factorize(pdf["sample_id"].fillna("") + "\n" + pdf["seq"])
        given = "sums" in pdf
        n = np.bincount(code, pdf["n"] if given else None, len(first)).astype(np.int64)
        wide = int(pdf["seq"].str.len().max() or 0) if len(pdf) else 0
        sums = np.zeros((len(first), wide), np.int64)
        for i, v in zip(code.tolist(), pdf["sums" if given else "qual"], strict=True):
            v = v if given else np.frombuffer(v.encode(), np.uint8)
            sums[i, : len(v)] += v if given else v.astype(np.int64) - 33
        at = np.full(len(first), len(pdf))
        np.minimum.at(at, code, np.arange(len(pdf)))
        seqs = pdf["seq"].to_numpy()[at]
        yield pa.RecordBatch.from_arrays([pa.array(pdf["sample_id"].to_numpy()[at], pa.string()), pa.array(seqs, pa.string()), pa.array(n), pa.array([x[: len(s)] for x, s in zip(sums, seqs, strict=True)], pa.list_(pa.int64()))], names=["sample_id", "seq", "n", "sums"])


def dereplicate(df: DataFrame) -> DataFrame:
    """Unique sequences of each sample: abundance, rank (most abundant first, then by letters) and mean qualities.

    Qualities are summed as integers by position, so sums do not depend on order: within Arrow batches before the shuffle, then
    the few partial sums of a sequence by position.
    """
    part = df.select("sample_id", F.upper("seq").alias("seq"), "qual").mapInArrow(_quality_sums, "sample_id string, seq string, n long, sums array<long>")
    n = part.groupBy("sample_id", "seq").agg(F.sum("n").alias("abundance"), F.collect_list("sums").alias("l"))
    total = F.when(F.size("l") == 1, F.get("l", F.lit(0))).otherwise(F.aggregate("l", F.array_repeat(F.lit(0).cast("long"), F.length("seq")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))
    order = Window.partitionBy("sample_id").orderBy(F.desc("abundance"), "seq")
    ranked = n.select("sample_id", "seq", "abundance", F.transform(total, lambda x: x / F.col("abundance")).alias("quals")).withColumn("uniq_idx", F.row_number().over(order) - 1)
    return ranked.select("sample_id", "uniq_idx", "seq", "abundance", "quals")


def uniques(df: DataFrame) -> DataFrame:
    """Sequences of each sample with abundance and rank."""
    n = df.groupBy("sample_id", F.upper("seq").alias("seq")).agg(F.count("*").alias("abundance"))
    return n.withColumn("uniq_idx", (F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("abundance"), "seq")) - 1).cast("long"))


def read_map(df: DataFrame) -> DataFrame:
    """For each read the rank of its sequence in its sample."""
    return df.select("sample_id", "read_id", F.upper("seq").alias("seq")).join(uniques(df), ["sample_id", "seq"]).select("sample_id", "read_id", "uniq_idx")


def quality_profile(df: DataFrame, most: int | None = None) -> DataFrame:
    """Mean and quartiles of the qualities of each cycle and sample."""
    df = df.filter(F.col("read_id") < most) if most is not None else df
    each = df.select("sample_id", F.posexplode(S.quals(F.col("qual"))).alias("cycle", "q"))
    return each.groupBy("sample_id", "cycle").agg(F.count("*").alias("n"), F.avg("q").alias("mean_q"), F.percentile("q", F.lit(0.25)).alias("q25"), F.percentile("q", F.lit(0.5)).alias("q50"), F.percentile("q", F.lit(0.75)).alias("q75"))


def kmer_counts(seqs: DataFrame, k: int = 5, key: str = "seq_id") -> DataFrame:
    return seqs.select(key, F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def kmer_distances(seqs: DataFrame, k: int = 5, most: float = 1.0, key: str = "seq_id") -> DataFrame:
    """1 - shared k-mers / (shorter length - k + 1) of pairs that share k-mers."""
    n = kmer_counts(seqs, k, key)
    size = seqs.select(key, F.length("seq").alias("len"))
    a, b = (n.join(size, key).select(F.col(key).alias(x), "kmer", F.col("n").alias(f"n{x}"), F.col("len").alias(f"len{x}")) for x in "ab")
    both = a.join(b, "kmer").filter("a < b").groupBy("a", "b", F.least("lena", "lenb").alias("len")).agg(F.sum(F.least("na", "nb")).alias("shared"))
    return both.select("a", "b", (1 - F.col("shared") / (F.col("len") - k + 1)).alias("distance")).filter(F.col("distance") <= most)
