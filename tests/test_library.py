"""Queries against their SQL on the smallest tables, kernels against goldens and slow models, sources in a round trip."""

import functools
import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampliflow import queries as library
from ampliflow.functions import seq as S
from ampliflow.kernels import align as A
from ampliflow.kernels.denoise import Options, Sample, abundance_p, upper_tail
from ampliflow.kernels.errors import binned_errors, flat_errors, loess_errors, pacbio_errors
from ampliflow.operators import tables as T
from ampliflow.operators.files import filter_and_trim
from ampliflow.sources.sequences import sequences_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["filter_single", "filter_paired", "trim_primers", "orient_reads", "derep_quals", "seqtab_merge_rc", "seqtab_wide", "species_exact", "nb_classify", "bimera_consensus", "sankey_links", "lineage_parse", "collapse_edges", "err_noqual", "collapse_no_mismatch", "shift_denovo", "taxonomy_ranks", "bimera_pooled", "bimera_per_sample", "names", "species_added", "unite_headers", "ordered_distances", "cycled_reads", "rank_totals", "oriented_pairs", "fastq_round_trip", "fasta_round_trip", "seqtab_columns", "err_binned", "merged_pairs", "gapless_substitutions", "distinct_sequences"])
def test_query_equals_sql(spark, duck, name):
    assert rows(library.queries()[name](spark, SF).toPandas()) == rows(duck.execute(library.oracle_sql()[name]).df())


def test_bootstrap_query_equals_plain_python(spark):
    refs = [(r.genus, r.seq) for r in library._reference(spark, SF).collect()]
    kmers = lambda s: [s[i : i + 8] for i in range(len(s) - 7)]
    genera = sorted({g for g, _ in refs})
    size = [sum(g == h for h, _ in refs) for g in genera]
    known = [(genera.index(g), w) for g, s in refs for w in set(kmers(s))]
    n, seen = Counter(known), Counter(w for _, w in known)

    @functools.cache
    def gains(w):
        prior = (seen[w] + 0.5) / (len(refs) + 1)
        return np.array([math.log((n[g, w] + prior) / (m + 1)) - math.log(prior) for g, m in enumerate(size)])

    best = lambda ws: genera[int(np.argmax(np.round(sum(gains(w) for w in ws), 9)))]
    asked = [r.seq for r in library.seqtab_long(spark, SF).select("seq").distinct().collect() if len(r.seq) >= 50]
    draws = spark.createDataFrame([(s,) for s in asked], "query string").selectExpr("query", "explode(sequence(1, 100)) AS round")
    draws = draws.selectExpr("query", "transform(sequence(1, cast(floor(length(query) / 8) AS int)), d -> cast(cast(conv(left(md5(concat_ws(':', query, round, d)), 8), 16, 10) AS long) % (length(query) - 7) AS int)) AS at").collect()
    full, boot = {s: best(kmers(s)) for s in asked}, Counter()
    for r in draws:
        boot[r.query] += best([r.query[i : i + 8] for i in r["at"]]) == full[r.query]
    want = sorted((s, full[s], boot[s]) for s in asked)
    assert sorted((r["query"], r.genus, r.boot) for r in library.nb_bootstrap(spark, SF).collect()) == want


def test_learned_errors_query_equals_plain_python(spark, monkeypatch):
    from ampliflow.kernels.errors import initial_errors
    from ampliflow.operators import reads as R

    r = library.reads(spark, SF)
    more = r.crossJoin(spark.range(8)).withColumn("read_id", r.read_id * 8 + F.col("id")).drop("id")
    monkeypatch.setattr(library, "reads", lambda *_: more)  # more than 200,000 bases
    uniques = R.dereplicate(library.filtered(spark, SF)).toPandas()
    assert (uniques.abundance * uniques.seq.str.len()).sum() > 200_000
    samples = [p.sort_values("uniq_idx") for _, p in uniques.groupby("sample_id")]
    err, seen = initial_errors(int(np.floor(max(max(q) for q in uniques.quals) + 0.5)) + 1), []
    for k in range(11):
        o = Options(omega_c=0, max_clust=1) if k == 0 else Options(omega_c=0)
        err = loess_errors(sum(Sample(p["seq"].tolist(), p["abundance"].tolist(), p["quals"].tolist(), err, o, None).run()["trans"] for p in samples))
        if k == 0:
            err[[0, 5, 10, 15]] = 1.0
        if any(np.array_equal(err, e) for e in seen):
            break
        seen.append(err)
    got = {("ACGT".index(r.from_nt) * 4 + "ACGT".index(r.to_nt), r.q): r.rate for r in library.learned_errors(spark, SF).collect()}
    assert len(got) == err.size and all(got[i, q] == pytest.approx(err[i, q], rel=1e-9) for i, q in got)


def slow_align(a, b, match, mismatch, gap):
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = max(d[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), d[i][j - 1] + (gap if i < n else 0), d[i - 1][j] + (gap if j < m else 0))
    return d[n][m]


def score(x, y, match, mismatch, gap):
    lo, hi = A._core(x, y)
    return sum(gap if "-" in (p, q) else match if p == q else mismatch for p, q in zip(x[lo:hi], y[lo:hi], strict=True))


def test_alignments_have_the_best_score():
    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("ACGT"), rng.integers(1, 12))), "".join(rng.choice(list("ACGT"), rng.integers(1, 12)))) for _ in range(200)]
    for (a, b), (x, y) in zip(pairs, A.align(pairs), strict=True):
        assert x.replace("-", "") == a and y.replace("-", "") == b
        assert score(x, y, 5, -4, -8) == slow_align(a, b, 5, -4, -8)


def test_consensus_and_counts():
    assert A.evaluate("--ACGT", "TTACGA") == (3, 1, 0)
    assert A.consensus("ACGTT--", "--GTTAA") == "ACGTTAA"
    assert A.consensus("--GTTAA", "ACGTT--") == "GTT" and A.consensus("--GTTAA", "ACGTT--", trim=False) == "ACGTTAA"
    assert A.consensus("ACGA", "ACGT", prefer=2) == "ACGT"


def slow_global(a, b, gap, run_gap):
    cost = lambda s: [run_gap if run_gap is not None and any(s[k : k + 3] == s[i] * 3 for k in range(max(0, i - 2), i + 1)) else gap for i in range(len(s))]
    ca, cb = cost(a), cost(b)
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [d[i - 1][j - 1] + (5 if a[i - 1] == b[j - 1] else -4)] if i and j else []
            ways += ([d[i - 1][j] + ca[i - 1]] if i else []) + ([d[i][j - 1] + cb[j - 1]] if j else [])
            d[i][j] = max(ways, default=0)
    return d[-1][-1], ca, cb


@pytest.mark.parametrize("run_gap", [None, -1])
def test_global_alignments_have_the_best_score(run_gap):
    rng = np.random.default_rng(3)
    pairs = [("".join(rng.choice(list("AAC"), rng.integers(1, 12))), "".join(rng.choice(list("AAC"), rng.integers(1, 12)))) for _ in range(150)]
    for (a, b), (x, y) in zip(pairs, A.align(pairs, free_ends=False, run_gap=run_gap), strict=True):
        want, ca, cb = slow_global(a, b, -8, run_gap)
        assert x.replace("-", "") == a and y.replace("-", "") == b
        got = i = j = 0
        for p, q in zip(x, y, strict=True):
            got += ca[i] if q == "-" else cb[j] if p == "-" else 5 if p == q else -4
            i, j = i + (p != "-"), j + (q != "-")
        assert got == want


def test_what_is_read_off_alignments():
    assert A.hamming([("ACGTACGT", "ACGAACGT"), ("ACGT", "ACGT")]) == [1, 0]
    assert A.gapless("ACG", "ACGTT") == ("ACG--", "ACGTT")
    assert A.substitutions("AC-GTN", "ATTG-A") == [(1, "C", "T")]
    assert A.inner_distance("--ACGT", "TTACCT") == 1
    assert A.coverage("ACGTACGT", "ACGAACCT") == (3, 1) and A.coverage("ACGTACGT", "ACGAACCT", misses=1) == (6, 4)


def test_columns_of_alignments_equal_the_kernel(spark):
    pairs = [("ACGT", "ACGA"), ("AC-GTN", "ACTGAA"), ("-ACG", "TACC"), ("", ""), ("AAAA", "CC")]
    df = spark.createDataFrame(pairs, "a string, b string")
    x, y = S.gapless(F.col("a"), F.col("b"))
    made = df.select("a", "b", x.alias("x"), y.alias("y")).withColumn("s", S.substitutions(F.col("x"), F.col("y"))).collect()
    for r in made:
        assert (r.x, r.y) == A.gapless(r.a, r.b) and [tuple(s) for s in r.s] == A.substitutions(r.x, r.y)


def test_sequences_of_all_kinds(spark, tmp_path):
    got = lambda found, **more: sorted(r.seq for r in sequences_of(spark, found, **more).collect())
    (tmp_path / "x.fasta").write_text(">a\nac\nGT\n>b\nACGT\n")
    (tmp_path / "x.fastq").write_text("@a\nacgn\n+\nIIII\n")
    assert got(str(tmp_path / "x.fasta")) == ["ACGT"] * 2 and got(str(tmp_path / "x.fasta"), collapse=True) == ["ACGT"]
    assert got(str(tmp_path / "x.fastq")) == ["ACGN"]
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder/y.fa").write_text(">a\nttt\n")
    assert got(str(tmp_path / "folder")) == ["TTT"]
    assert got("acg") == ["ACG"] and got(["a", "A"], collapse=True) == ["A"] and got([]) == [] and got({"ac": 3}) == ["AC"]
    assert got(pd.DataFrame({"sequence": ["a"]})) == ["A"] and got(pd.DataFrame({"ac": [1], "g": [2]})) == ["AC", "G"] and got(pd.Series(["t"])) == ["T"]
    assert got(spark.createDataFrame([("a", 1)], "seq string, n long")) == ["A"] and got(spark.createDataFrame([(1,)], "acgt long")) == ["ACGT"]
    with pytest.raises(TypeError):
        sequences_of(spark, 3)


@pytest.mark.parametrize("by", ["abundance", "nsamples"])
def test_column_order_of_ties_and_empty_tables(spark, by):
    found = [(f"s{k % 7}", f"{'ACGT'[k % 4]}{k % 60}", k % 3 + 1) for k in range(400)]
    table = spark.createDataFrame(found, "sample_id string, seq string, abundance long")
    n = Counter()
    for _, seq, m in found:
        n[seq] += m if by == "abundance" else 1
    made = T.ordered_columns(table, by).collect()
    assert [r.seq for r in sorted(made, key=lambda r: r.column)] == sorted(n, key=lambda x: (-n[x], x))
    assert sorted(r.column for r in made) == list(range(1, len(n) + 1))
    assert T.ordered_columns(table.limit(0), by).count() == 0


def test_filter_files(spark, tmp_path):
    record = "@{}\n{}\n+\n{}\n".format
    for side in "fr":
        (tmp_path / side).mkdir()
    (tmp_path / "f/s.fastq").write_text(record("a", "TT" + "ACGTACGTAC" * 3, "I" * 32) + record("b", "N" * 32, "I" * 32))
    (tmp_path / "r/s2.fastq").write_text(record("a", "CCAGGTTACA" * 3, "I" * 30) + record("b", "CCAGGTTACA" * 3, "I" * 30))
    run = lambda *paths, **more: [tuple(r) for r in filter_and_trim(spark, *(str(tmp_path / p) for p in paths), compress=False, **more).collect()]
    assert run("f", "single", trim_left=2) == [("s", 2, 1)]
    assert (tmp_path / "single/s.fastq").read_text() == record("a", "ACGTACGTAC" * 3, "I" * 30)
    assert run("f", "fwd", "r", "rev", trunc_len=(20, 25)) == [("s", 2, 1)]
    assert [len((tmp_path / p).read_text().split("\n")[1]) for p in ("fwd/s.fastq", "rev/s2.fastq")] == [20, 25]
    assert run("r", "none", max_ee=0.0) == [("s2", 2, 0)] and (tmp_path / "none/s2.fastq").read_text() == ""
    with pytest.raises(ValueError):
        filter_and_trim(spark, "f", "x", "r")


def test_bimeras_with_one_wrong_letter(spark):
    from ampliflow.operators import denoise as D
    from ampliflow.operators import tables as T

    rng = np.random.default_rng(5)
    a, b = ("".join(rng.choice(list("ACGT"), 60)) for _ in range(2))
    clean, off = a[:30] + b[30:], a[:30] + b[30:45] + ("A" if b[45] != "A" else "C") + b[46:]
    assert D.is_bimera(clean, [a, b]) and not D.is_bimera(off, [a, b]) and D.is_bimera(off, [a, b], allow_one_off=True) and not D.is_bimera(a, [b])
    table = spark.createDataFrame([("s", a, 100), ("s", b, 90), ("s", clean, 5), ("s", off, 4), ("t", clean, 9)], "sample_id string, seq string, abundance long")
    flagged = lambda **o: {r.seq for r in D.bimeras(table.filter("sample_id = 's'"), **o).filter("flag").collect()}
    assert flagged() == {clean} and flagged(allow_one_off=True) == {clean, off}
    left = lambda m: {(r.sample_id, r.seq) for r in T.remove_bimeras(table, m, D.bimeras).collect()}
    assert left("pooled") == {("s", a), ("s", b), ("s", off)} and left("per-sample") == {("s", a), ("s", b), ("s", off), ("t", clean)} == left("consensus") | {("t", clean)}
    with pytest.raises(ValueError):
        T.remove_bimeras(table, "other")


def test_collapse_of_a_long_chain_and_shifts(spark):
    from ampliflow.operators import tables as T
    from ampliflow.operators.resolve import shifts

    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("ACGT"), 140))
    rows_ = [("s", long[:n], 1000 - n) for n in range(20, 120)] + [("s", "C" * 5, 3)]
    out = T.collapse(spark.createDataFrame(rows_, "sample_id string, seq string, abundance long")).collect()
    assert {(r.seq, r.abundance) for r in out if r.seq != "CCCCC"} == {(long[:119], sum(1000 - n for n in range(20, 120)))}
    u = spark.createDataFrame([(long[:60], 9), (long[30:90], 8), (long[60:120], 7), ("G" * 40, 5)], "seq string, abundance long")
    assert {(r.abundance, r.is_shift) for r in shifts(u).collect()} == {(9, False), (8, True), (7, False), (5, False)}


def test_error_rates_are_checked():
    from ampliflow.operators.denoise import checked_errors

    err = np.full((16, 3), 0.25)
    assert checked_errors([{"err_out": err}, {"err_out": err.copy()}]) is not None
    for bad in ([], [{"err_out": err}, {"err_out": err / 2}], err[:4], err * 5, {"err_out": None}):
        with pytest.raises(ValueError):
            checked_errors(bad)


def test_pairs_by_variants(spark):
    from ampliflow.operators.denoise import merge_denoised
    from ampliflow.operators.reads import dereplicate

    rng = np.random.default_rng(8)
    amplicon = "".join(rng.choice(list("ACGT"), 70))
    rc_ = amplicon[::-1].translate(str.maketrans("ACGT", "TGCA"))
    off = lambda s, k: s[:k] + ("A" if s[k] != "A" else "C") + s[k + 1 :]
    reads = lambda s: spark.createDataFrame([("x", i, off(s[:50], 7) if i == 3 else s[:49] + "N" if i == 4 else s[:50], "I" * 50) for i in range(300)], "sample_id string, read_id long, seq string, qual string")
    err = np.where(np.eye(4).reshape(16, 1) > 0, 0.97, 0.01) * np.ones((1, 41))
    out = merge_denoised(reads(amplicon), reads(rc_), err, err).collect()
    assert [(r.seq, r.abundance, r.accept) for r in out] == [(amplicon, 299, True)]
    assert dereplicate(reads(amplicon).limit(0)).collect() == []


def test_files_of_samples(spark, tmp_path):
    from ampliflow.sources.sequences import register

    register(spark)
    df = spark.createDataFrame([("b", 2, "@2", "GG", "+", "II"), ("a", 1, "@1", "AC", "+", "II"), ("b", 0, "@0", "TT", "+", "II")], "sample_id string, read_id long, header string, seq string, sep string, qual string")
    df.repartition(3, "sample_id").sortWithinPartitions("sample_id", "read_id").write.format("fastq").option("bySample", "true").option("samples", "a,b,c").mode("overwrite").save(str(tmp_path / "x"))
    assert sorted(os.listdir(tmp_path / "x")) == ["a.fastq.gz", "b.fastq.gz", "c.fastq.gz"]
    assert [(r.sample_id, r.read_id, r.header) for r in spark.read.format("fastq").load(str(tmp_path / "x")).orderBy("sample_id", "read_id").collect()] == [("a", 0, "@1"), ("b", 0, "@0"), ("b", 1, "@2")]
    spark.createDataFrame([("AC",), ("GT",), ("TT",)], "seq string").repartition(3).write.format("fasta").mode("overwrite").save(str(tmp_path / "y"))
    assert len({r.header for r in spark.read.format("fasta").load(str(tmp_path / "y")).collect()}) == 3


def test_poisson_tail():
    exact = lambda k, m: 1 - sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k))
    for k, m in ((10, 12.5), (3, 0.7), (40, 30.0), (1, 5.0)):
        assert upper_tail(k, m) == pytest.approx(exact(k, m), rel=1e-9)
    assert abundance_p(1, 1e-9) == pytest.approx(1, rel=1e-6)


def test_error_models_sum_to_one():
    rng = np.random.default_rng(2)
    trans = rng.integers(0, 500, (16, 40))
    for model in (loess_errors, flat_errors, binned_errors([2, 12, 30]), pacbio_errors):
        assert np.allclose(model(trans).reshape(4, 4, -1).sum(1), 1)


# A transition matrix and the rates known for it.
TRANS = [
    [1000, 900, 800, 700, 650, 600, 550, 500, 450, 400],
    [10, 11, 12, 13, 12, 11, 10, 9, 8, 7],
    [20, 18, 16, 15, 14, 13, 12, 11, 10, 9],
    [30, 28, 26, 24, 22, 20, 18, 16, 14, 12],
    [15, 14, 13, 12, 11, 10, 9, 8, 7, 6],
    [1100, 1000, 920, 840, 760, 700, 650, 600, 560, 520],
    [25, 23, 21, 19, 17, 16, 15, 14, 13, 12],
    [35, 33, 31, 29, 27, 25, 23, 21, 19, 17],
    [12, 11, 10, 9, 8, 7, 7, 6, 6, 5],
    [22, 21, 20, 19, 18, 17, 16, 15, 14, 13],
    [1200, 1110, 1020, 930, 860, 800, 740, 690, 640, 600],
    [40, 38, 36, 34, 32, 30, 28, 26, 24, 22],
    [18, 17, 16, 15, 14, 13, 12, 11, 10, 9],
    [28, 27, 25, 23, 21, 19, 17, 15, 13, 12],
    [38, 36, 34, 32, 30, 28, 26, 24, 22, 20],
    [1300, 1210, 1130, 1050, 980, 920, 860, 810, 760, 720],
]
#: By row, the rates at qualities 0, 3, 6 and 9.
RATES = {
    0: [0.9408713362289174, 0.9281020850062308, 0.9271185534848777, 0.9275648699323125],
    1: [0.010245512716245022, 0.018023988502644868, 0.018644067853527305, 0.01869130536226992],
    4: [0.013633623826503868, 0.014470379796805837, 0.014378947163017016, 0.012615818433517693],
    7: [0.03067742435678946, 0.03339325060601197, 0.03450933077142074, 0.03242789523714883],
    10: [0.939662046231448, 0.9346308709819259, 0.9322356674834911, 0.9325944240128806],
    14: [0.028174273318859102, 0.029443652942203514, 0.029458199724582582, 0.027631520193555928],
    15: [0.9370740834876777, 0.934867056921696, 0.9367190476370794, 0.9422772996879133],
}


def test_loess_known_rates():
    err = loess_errors(np.array(TRANS))
    assert err.shape == (16, 10) and ((err >= 1e-7) & (err <= 1)).all()
    for row, rates in RATES.items():
        assert err[row, [0, 3, 6, 9]] == pytest.approx(rates, abs=1e-12)


def test_denoiser_keeps_reads():
    err = loess_errors(np.where(np.eye(4).astype(bool).reshape(16, 1), 100_000, 30) * np.ones((1, 41), int))
    seq = "ACGTTGCAAGTCCATGACGTTGCAAGTCCATG"
    near = "T" + seq[1:]
    far = seq[:10] + "TTTTT" + seq[15:]
    out = Sample([seq, far, near], [5000, 800, 3], [[35] * len(seq)] * 3, err, Options()).run()
    assert [c["seq"] for c in out["clusters"]] == [seq, far]
    assert sum(c["abundance"] for c in out["clusters"]) == 5803 and out["trans"].sum() == 5803 * len(seq)


def test_births_of_clusters(spark):
    from ampliflow.operators.denoise import birth_substitutions, denoise

    err = loess_errors(np.where(np.eye(4).astype(bool).reshape(16, 1), 100_000, 30) * np.ones((1, 41), int))
    seq = "ACGTTGCAAGTCCATGACGTTGCAAGTCCATG"
    far = seq[:10] + "TTTTT" + seq[15:]
    q = [35.0] * 10 + [20.0] * 5 + [35.0] * 17
    df = spark.createDataFrame([("s", 0, seq, 5000, [35.0] * 32), ("s", 1, far, 800, q)], "sample_id string, uniq_idx long, seq string, abundance long, quals array<double>")
    old, new = denoise(df, err).orderBy("cluster").collect()
    changed = [i for i in range(32) if seq[i] != far[i]]
    assert (old.birth_from, old.birth_p, old.birth_fold, old.birth_ham, old.birth_q, new.birth_from, new.birth_ham, new.birth_q) == (None, None, None, None, None, 0, len(changed), 20.0)
    rate = math.prod(err[4 * "ACGT".index(a) + "ACGT".index(b), int(x)] for a, b, x in zip(seq, far, q, strict=True))
    assert new.birth_fold == pytest.approx(800 / (rate * 5800)) and new.birth_p == pytest.approx(2 * abundance_p(800, rate * 5800))
    assert new.pval == pytest.approx(abundance_p(800, rate * 5000, True)) and 0 <= old.pval <= 1
    subs = birth_substitutions(df, err).orderBy("pos").collect()
    assert [(r.cluster, r.pos, r.from_nt, r.to_nt, r.q) for r in subs] == [(1, i, seq[i], far[i], 20) for i in changed]
    flat = Sample([seq, far], [5000, 800], [[35] * 32, q], err, Options(use_quals=False))
    assert not any(x.any() for x in flat.quals)


def test_sequences_that_hold_others(spark):
    from ampliflow.operators.tables import held

    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ACGT"), n))
    whole = ["ACGTACGTACGTACGTACGT" + word(int(rng.integers(0, 40))) for _ in range(40)] + ["", "A" * 50, "N" * 17]
    part = [w[i : i + n] for w in whole for i, n in [(int(rng.integers(0, 20)), int(rng.integers(1, 30)))]] + whole + [word(5), word(16), word(70)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *xs, None]], "seq string")
    got = sorted(map(tuple, held(frame(part), frame(whole)).collect()))
    assert got == sorted({(a, b) for a in part if a for b in whole if a in b})
    assert held(frame([]), frame(whole)).count() == held(frame(part), frame([])).count() == 0


def test_sources_round_trip(spark, tmp_path):
    from ampliflow.sources.sequences import register

    register(spark)
    df = spark.createDataFrame([("@a", "ACGT", "+", "IIII"), ("@b", "GG", "+", "##")], "header string, seq string, sep string, qual string").coalesce(1)
    df.write.format("fastq").mode("overwrite").save(str(tmp_path / "x"))
    back = spark.read.format("fastq").load(str(tmp_path / "x"))
    assert [(r.header, r.seq, r.qual) for r in back.orderBy("read_id").collect()] == [("@a", "ACGT", "IIII"), ("@b", "GG", "##")]
    assert spark.read.format("fastq").option("maxRecords", "1").load(str(tmp_path / "x")).count() == 1
    (tmp_path / "r.fasta").write_text(">one x\nacg\nT\n>two\nGG\n")
    fasta = spark.read.format("fasta").load(str(tmp_path / "r.fasta"))
    assert [(r.header, r.seq) for r in fasta.orderBy("ref_id").collect()] == [("one x", "ACGT"), ("two", "GG")]


def test_streamed_uniques_equal_batch(spark, tmp_path):
    from ampliflow.operators.reads import uniques
    from ampliflow.streaming.reads import filter_stream, uniques_stream

    reads = spark.createDataFrame([(i, "s" + str(i % 2), "ACGT" * (6 + i % 3), "I" * 4 * (6 + i % 3)) for i in range(40)], "read_id long, sample_id string, seq string, qual string")
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = uniques_stream(filter_stream(stream, min_len=25)).writeStream.outputMode("complete").format("memory").queryName("uniques_seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = uniques(filter_stream(reads, min_len=25)).select("sample_id", "seq", "abundance").toPandas()
    assert rows(spark.table("uniques_seen").toPandas()) == rows(want) and len(want)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_command_line(spark, tmp_path):
    from ampliflow.cli import main

    seq = "ACGTTGCAAGTCCATGACGTTGCAAGTCCATGTTAGCCATGACCTTGAACGT"
    (tmp_path / "a.fastq").write_text("".join(f"@r{i}\n{seq if i else 'N' * len(seq)}\n+\n{'I' * len(seq)}\n" for i in range(5)))
    main(["filter-trim", str(tmp_path / "a.fastq"), str(tmp_path / "out"), "--max-ee", "1"])
    stats = spark.read.csv(str(tmp_path / "out_stats"), sep="\t", header=True).collect()
    assert [(r["sample"], r["reads_in"], r["reads_out"]) for r in stats] == [("a", "5", "4")]
    (tmp_path / "q.fasta").write_text(f">q\n{seq}\n")
    (tmp_path / "r.fasta").write_text(f">1 K;P;\n{seq}\n>2 K;Q;\n{seq[::-1]}\n")
    main(["assign-taxonomy", str(tmp_path / "q.fasta"), str(tmp_path / "r.fasta"), str(tmp_path / "tax"), "--rounds", "10", "--levels", "Kingdom,Phylum"])
    assert [(r.Kingdom, r.Phylum, r.Phylum_boot) for r in spark.read.csv(str(tmp_path / "tax"), sep="\t", header=True).collect()] == [("K", "P", "100")]


def test_command_line_of_pairs(spark, tmp_path):
    from ampliflow.cli import main
    from ampliflow.sources.sequences import register

    seq = "ACGTTGCAAGTCCATGACGTTGCAAGTCCATGTTAGCCATGACCTTGAACGT"
    bad = "N" * len(seq)
    for name, of in (("a_R1", [seq, bad, seq]), ("a_R2", [seq, seq, bad]), ("b_R1", [bad]), ("b_R2", [seq])):
        (tmp_path / name[-2:]).mkdir(exist_ok=True)
        (tmp_path / name[-2:] / f"{name}.fastq").write_text("".join(f"@{name}.{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(of)))
    main(["filter-trim", *[str(tmp_path / x) for x in ("R1", "out1", "R2", "out2")], "--trunc-len", "50", "--trunc-len-reverse", "40", "--plain"])
    register(spark)
    back = spark.read.format("fastq").load(f"{tmp_path}/out1,{tmp_path}/out2").orderBy("sample_id").collect()
    assert [(r.sample_id, r.header, len(r.seq)) for r in back] == [("a_R1", "@a_R1.0", 50), ("a_R2", "@a_R2.0", 40)]
    assert (tmp_path / "out1" / "b_R1.fastq").read_text() == (tmp_path / "out2" / "b_R2.fastq").read_text() == ""
    stats = spark.read.csv(str(tmp_path / "out1_stats"), sep="\t", header=True).orderBy("sample").collect()
    assert [(r["sample"], r["reads_in"], r["reads_out"]) for r in stats] == [("a_R1", "3", "1"), ("b_R1", "1", "0")]
