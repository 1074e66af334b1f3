"""Denoising of samples, error learning, pair merging and gapped chimeras."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..kernels import align as A
from ..kernels.denoise import Options, Sample
from ..kernels.errors import initial_errors, loess_errors
from .reads import dereplicate
from .resolve import saved

CLUSTERS = "sample_id string, cluster long, seq string, abundance long, n0 long, n1 long, nunq long, pval double, birth_from long, birth_p double, birth_fold double, birth_ham long, birth_q double"


def _sample(pdf: pd.DataFrame, err: np.ndarray, options: Options, priors: set[str] | None) -> dict:
    pdf = pdf.sort_values("uniq_idx")
    return Sample(pdf["seq"].tolist(), pdf["abundance"].tolist(), pdf["quals"].tolist(), err, options, priors).run()


def denoise(uniques: DataFrame, err: np.ndarray, options: Options | None = None, priors: set[str] | None = None) -> DataFrame:
    """Exact variants of each sample of ``dereplicate``'s rows: one group, one task, as clusters depend on all uniques.

    ``pval``: of a centre's reads, given those expected from all other clusters. The birth of a cluster: the one it left, its p
    (times the number of uniques, unless by a prior), reads over expected ones, substitutions and their mean quality; null for the first.
    """
    options = options or Options()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_sample(pdf, err, options, priors)["clusters"]).astype({"birth_from": "Int64", "birth_ham": "Int64", "birth_p": float, "birth_fold": float, "birth_q": float})
        out.insert(0, "sample_id", pdf["sample_id"].iloc[0])
        return out

    return uniques.groupBy("sample_id").applyInPandas(run, CLUSTERS)


def birth_substitutions(uniques: DataFrame, err: np.ndarray, options: Options | None = None) -> DataFrame:
    """The substitutions that set each cluster's centre apart from that of the cluster it left: (sample_id, cluster, pos, from_nt, to_nt, q), from 0."""
    options = options or Options()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_sample(pdf, err, options, None)["births"], columns=["cluster", "pos", "from_nt", "to_nt", "q"])
        out.insert(0, "sample_id", pdf["sample_id"].iloc[0])
        return out

    return uniques.groupBy("sample_id").applyInPandas(run, "sample_id string, cluster long, pos long, from_nt string, to_nt string, q long")


def denoise_map(uniques: DataFrame, err: np.ndarray, options: Options | None = None) -> DataFrame:
    """For each unique its cluster (-1: none explains it) and p."""
    options = options or Options()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uniq_idx")
        made = _sample(pdf, err, options, None)
        return pd.DataFrame({"sample_id": pdf["sample_id"], "uniq_idx": pdf["uniq_idx"], "cluster": made["map"], "pval": made["p"]})

    return uniques.groupBy("sample_id").applyInPandas(run, "sample_id string, uniq_idx long, cluster long, pval double")


def denoise_both(uniques: DataFrame, err: np.ndarray, options: Options | None = None) -> DataFrame:
    """Clusters (cluster, seq) and the clusters of uniques (uniq_idx, cluster) of each sample, from one run."""
    options = options or Options()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uniq_idx")
        made = _sample(pdf, err, options, None)
        of = pd.DataFrame({"uniq_idx": pdf["uniq_idx"].to_numpy(), "cluster": made["map"], "seq": None})
        named = pd.DataFrame({"uniq_idx": None, "cluster": [c["cluster"] for c in made["clusters"]], "seq": [c["seq"] for c in made["clusters"]]})
        out = pd.concat([of.astype(object), named.astype(object)], ignore_index=True)
        out.insert(0, "sample_id", pdf["sample_id"].iloc[0])
        return out

    return uniques.groupBy("sample_id").applyInPandas(run, "sample_id string, uniq_idx long, cluster long, seq string")


def profiles(uniques: DataFrame, err: np.ndarray, options: Options | None = None) -> DataFrame:
    """Each unique against its cluster's centre, position by position: (sample_id, cluster, uniq_idx, pos, from_nt, to_nt, q, reads, rate).

    ``rate`` is the probability of any other letter there. From these follow ``substitutions`` and ``cluster_quality``.
    """
    options = options or Options()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uniq_idx")
        sample = Sample(pdf["seq"].tolist(), pdf["abundance"].tolist(), pdf["quals"].tolist(), err, options, None)
        made = sample.run()
        rows = []
        for i, c in enumerate(made["map"].tolist()):
            if c >= 0:
                centre = sample.seqs.index(made["clusters"][c]["seq"])
                change, q = sample.compare(centre, np.array([i]), 2.0)[i][2], sample.quals[i]
                same = 5 * (change // 4)
                rows.append(pd.DataFrame({"cluster": c, "uniq_idx": i, "pos": np.arange(len(change)), "from_nt": np.array(list("ACGT"))[change // 4], "to_nt": np.array(list("ACGT"))[change % 4], "q": q, "reads": int(sample.reads[i]), "rate": 1 - err[same, q]}))
        out = pd.concat(rows, ignore_index=True) if rows else pd.DataFrame(columns=["cluster", "uniq_idx", "pos", "from_nt", "to_nt", "q", "reads", "rate"])
        out.insert(0, "sample_id", pdf["sample_id"].iloc[0])
        return out

    return uniques.groupBy("sample_id").applyInPandas(run, "sample_id string, cluster long, uniq_idx long, pos long, from_nt string, to_nt string, q long, reads long, rate double")


def substitutions(profile: DataFrame) -> DataFrame:
    """At each position of a sample: letters, substitutions and expected ones."""
    other = F.when(F.col("from_nt") != F.col("to_nt"), F.col("reads")).otherwise(0)
    return profile.groupBy("sample_id", "pos").agg(F.sum("reads").alias("nts"), F.sum(other).alias("subs"), F.sum(F.col("reads") * F.col("rate")).alias("expected"))


def cluster_quality(profile: DataFrame) -> DataFrame:
    """The mean quality of the reads of a cluster at each position."""
    return profile.groupBy("sample_id", "cluster", "pos").agg((F.sum(F.col("q") * F.col("reads")) / F.sum("reads")).alias("q"))


def checked_errors(found, enforce: bool = True) -> np.ndarray:
    """The error rates of a matrix or of results ({"err_out": matrix}), which must agree: 16 rows of rates from 0 to 1."""
    some = [r["err_out"] for r in found] if isinstance(found, list) else [found["err_out"] if isinstance(found, dict) else found]
    if not some or any(e is None for e in some):
        raise ValueError("no error rates")
    err = np.asarray(some[0], float)
    if any(not np.array_equal(err, e) for e in some[1:]):
        raise ValueError("results differ in their error rates")
    if enforce and (err.ndim != 2 or len(err) != 16 or not ((err >= 0) & (err <= 1)).all()):
        raise ValueError("error rates must be 16 rows of numbers from 0 to 1")
    return err


def transitions(uniques: DataFrame, err: np.ndarray, options: Options) -> np.ndarray:
    """Transitions of all samples: summed by Spark, at most 16 x Q numbers come to the driver."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _sample(pdf, err, options, None)["trans"]
        row, q = np.nonzero(t)
        return pd.DataFrame({"change": row, "q": q, "n": t[row, q]})

    total = np.zeros(err.shape, np.int64)
    for r in uniques.groupBy("sample_id").applyInPandas(run, "change long, q long, n long").groupBy("change", "q").agg(F.sum("n").alias("n")).collect():
        total[r.change, r.q] = r.n
    return total


def learning_subset(uniques: DataFrame, bases: int) -> DataFrame:
    """Samples in order, up to and with the one that reaches ``bases``."""
    n = uniques.groupBy("sample_id").agg(F.sum(F.col("abundance") * F.length("seq")).alias("bases"))
    before = F.sum("bases").over(Window.orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1))
    return n.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < bases).select("sample_id", "bases")


def learn_errors(uniques: DataFrame, bases: int = 100_000_000, model: Callable[[np.ndarray], np.ndarray] = loess_errors, rounds: int = 10, options: Options | None = None) -> np.ndarray:
    """Error rates that agree with the variants found under them: one Spark job a round, until a matrix recurs."""
    o = options or Options(omega_c=0)
    some = uniques.join(learning_subset(uniques, bases).select("sample_id"), "sample_id", "left_semi").persist()
    top = some.agg(F.max(F.array_max("quals"))).first()[0] or 40
    err = initial_errors(int(np.floor(top + 0.5)) + 1)
    first = Options(**{**o.__dict__, "max_clust": 1})
    seen, settled = [], False
    for k in range(rounds + 1):
        new = model(transitions(some, err, first if k == 0 else o))
        if k == 0:
            new[[0, 5, 10, 15]] = 1.0  # the first estimate takes every difference for an error
        settled = any(np.array_equal(new, e) for e in seen)
        seen.append(new)
        err = new
        if settled:
            break
    some.unpersist()
    if not settled:
        warnings.warn(f"error rates still change after {rounds} rounds", stacklevel=2)
    return err


def error_rows(spark, err: np.ndarray) -> DataFrame:
    rows = [("ACGT"[i // 4], "ACGT"[i % 4], q, float(err[i, q])) for i in range(16) for q in range(err.shape[1])]
    return spark.createDataFrame(rows, "from_nt string, to_nt string, q long, rate double")


def aligned(pairs: DataFrame, trim_overhang: bool = False, **options) -> DataFrame:
    """Distinct pairs (a, b) with al1, al2, nmatch, nmismatch, nindel, merged: aligned in Arrow batches."""

    def run(batches):
        for pdf in batches:
            made = A.align(list(zip(pdf["a"], pdf["b"], strict=True)), **options)
            pdf["al1"], pdf["al2"] = [x for x, _ in made], [y for _, y in made]
            counts = [A.evaluate(*m) for m in made]
            for i, c in enumerate(("nmatch", "nmismatch", "nindel")):
                pdf[c] = [n[i] for n in counts]
            pdf["merged"] = [A.consensus(*m, trim=trim_overhang) for m in made]
            yield pdf

    return pairs.select("a", "b").distinct().mapInPandas(run, "a string, b string, al1 string, al2 string, nmatch long, nmismatch long, nindel long, merged string")


def merge_pairs(fwd: DataFrame, rev: DataFrame, min_overlap: int = 12, max_mismatch: int = 0, trim_overhang: bool = False, just_concatenate: bool = False) -> DataFrame:
    """Merge variants of mates: (sample_id, read_id, seq) of both, counted by pair, aligned once for each distinct pair; most abundant pairs first."""
    n = fwd.select("sample_id", "read_id", F.col("seq").alias("forward")).join(rev.select("sample_id", "read_id", F.col("seq").alias("reverse")), ["sample_id", "read_id"]).groupBy("sample_id", "forward", "reverse").agg(F.count("*").alias("abundance"))
    n = n.withColumns({"a": F.col("forward"), "b": S.rc(F.col("reverse"))})
    if just_concatenate:
        return n.select("sample_id", F.concat("a", F.lit("N" * 10), "b").alias("seq"), "forward", "reverse", "abundance", F.lit(0).cast("long").alias("nmatch"), F.lit(0).cast("long").alias("nmismatch"), F.lit(0).cast("long").alias("nindel"), F.lit(True).alias("accept"))
    cost = -64 if max_mismatch == 0 else -8
    both = n.join(aligned(n, trim_overhang, match=1, mismatch=cost, gap=cost), ["a", "b"])
    accept = (F.col("nmatch") >= min_overlap) & (F.col("nmismatch") + F.col("nindel") <= max_mismatch)
    return both.select("sample_id", F.when(accept, F.col("merged")).otherwise("").alias("seq"), "forward", "reverse", "abundance", "nmatch", "nmismatch", "nindel", accept.alias("accept")).orderBy(F.desc("abundance"), "sample_id", "forward", "reverse")


def variants_of_reads(reads: DataFrame, uniques: DataFrame, maps: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sample_id, read_id, seq): for each read the variant that explains it, by its unique and that one's cluster; reads without one go."""
    own = uniques.select("sample_id", F.col("seq").alias("read"), "uniq_idx").join(maps.filter("cluster >= 0"), ["sample_id", "uniq_idx"])
    named = own.join(clusters.select("sample_id", "cluster", "seq"), ["sample_id", "cluster"]).select("sample_id", "read", "seq")
    return reads.select("sample_id", "read_id", F.upper("seq").alias("read")).join(named, ["sample_id", "read"]).select("sample_id", "read_id", "seq")


def merge_denoised(fwd: DataFrame, rev: DataFrame, err_fwd: np.ndarray, err_rev: np.ndarray, options: Options | None = None, **merge) -> DataFrame:
    """Filtered reads of both mates, denoised each and merged by the variants of a pair's reads. Reads with other letters than A, C, G, T go."""
    sides = []
    for reads, err in ((fwd, err_fwd), (rev, err_rev)):
        reads = reads.filter(~F.col("seq").rlike("[^ACGTacgt]"))
        uniques = dereplicate(reads)
        both = saved(denoise_both(uniques, err, options))
        clusters = both.filter("seq IS NOT NULL").select("sample_id", "cluster", "seq")
        sides.append(variants_of_reads(reads, uniques.select("sample_id", "seq", "uniq_idx"), both.filter("uniq_idx IS NOT NULL").select("sample_id", "uniq_idx", "cluster"), clusters))
    return merge_pairs(*sides, **merge)


def bimeras(table: DataFrame, min_fold: float = 1.5, min_abund: int = 2, max_shift: int = 16, allow_one_off: bool = False, min_one_off_par_dist: int = 4) -> DataFrame:
    """Flags of sequences that a left part of one and a right part of another more abundant one explain, gaps allowed.

    With ``allow_one_off`` one of the parts may hold one mismatch, if both are of parents at that distance at least.
    """
    q = table.select("sample_id", "seq", "abundance")
    p = q.select("sample_id", F.col("seq").alias("b"), F.col("abundance").alias("n"))
    pairs = q.withColumnRenamed("seq", "a").join(p, "sample_id").filter((F.col("n") > min_fold * F.col("abundance")) & (F.col("n") >= min_abund))
    names = ["left", "right", "left_off", "right_off", "apart"]

    def run(batches):
        for pdf in batches:
            made = A.align(list(zip(pdf["a"], pdf["b"], strict=True)), band=max_shift)
            for name, values in zip(names, zip(*[(*A.coverage(x, y, max_shift), *A.coverage(x, y, max_shift, 1), A.inner_distance(x, y)) for x, y in made], strict=True), strict=True):
                pdf[name] = values
            yield pdf

    cover = pairs.select("a", "b").distinct().mapInPandas(run, "a string, b string, " + ", ".join(f"{n} long" for n in names))
    used = pairs.join(cover, ["a", "b"]).filter(F.col("left") + F.col("right") < F.length("a"))
    size, far = F.first(F.length("a")), F.col("apart") >= min_one_off_par_dist
    best = lambda c: F.coalesce(F.max(F.when(far, F.col(c))), F.lit(0))
    flag = F.max("left") + F.max("right") >= size
    if allow_one_off:
        flag = flag | (best("left") + best("right_off") >= size) | (best("left_off") + best("right") >= size)
    flags = used.groupBy("sample_id", F.col("a").alias("seq")).agg(flag.alias("flag"))
    return q.join(flags, ["sample_id", "seq"], "left").select("sample_id", "seq", "abundance", F.coalesce("flag", F.lit(False)).alias("flag"))


def is_bimera(seq: str, parents: list[str], max_shift: int = 16, allow_one_off: bool = False, min_one_off_par_dist: int = 4) -> bool:
    """Is a sequence the left part of one parent and the right part of another?"""
    best, near, off = [0, 0], [0, 0], [0, 0]
    for x, y in A.align([(seq, p) for p in parents], band=max_shift):
        ends = A.coverage(x, y, max_shift)
        if sum(ends) < len(seq):
            best = [max(a, b) for a, b in zip(best, ends, strict=True)]
            if A.inner_distance(x, y) >= min_one_off_par_dist:
                near = [max(a, b) for a, b in zip(near, ends, strict=True)]
                off = [max(a, b) for a, b in zip(off, A.coverage(x, y, max_shift, 1), strict=True)]
    return sum(best) >= len(seq) or allow_one_off and max(near[0] + off[1], off[0] + near[1]) >= len(seq)
