"""The queries of the library and the SQL they equal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import seq as S
from .kernels.errors import LEAST, MOST, binned_errors, loess_errors
from .operators import denoise as D
from .operators import reads as R
from .operators import tables as T
from .operators.resolve import shared_path, shifts
from .plans.fixtures import LENGTH, READS, reads, templates
from .sources.sequences import register, sequences_of

ORACLES: dict[str, str] = {}
START = "TT"
FILTER = {"trim_left": 2, "trim_right": 2, "min_len": 40, "max_n": 0, "max_ee": 0.2125}
_RC = "reverse(translate(regexp_replace({0}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
_EE = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: power(10.0, -(ascii(substr({0}, i, 1)) - 33) / 10.0)))"
_KNOWN = "[" + ", ".join(f"'{w}'" for w in S.words_of(S.PHIX, 16)) + "]"
_PHIX = "len(list_filter(range(1, length({0}) - 14), lambda i: list_contains(" + _KNOWN + ", substr({0}, i, 16))))"
FILTERED = (
    READS
    + f""",
cut AS (SELECT read_id, sample_id, substr(seq, 3, length(seq) - 4) AS seq, substr(qual, 3, length(qual) - 4) AS qual, tid, h FROM reads),
filtered AS (SELECT * FROM cut WHERE length(seq) >= 40 AND length(regexp_replace(seq, '[ACGTacgt]', '', 'g')) <= 0 AND round({_EE.format("qual")}, 9) <= 0.2125 AND {_PHIX.format("seq")} < 2),
uniq AS (SELECT sample_id, upper(seq) AS seq, count(*) AS abundance FROM filtered GROUP BY ALL)"""
)


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_reads(reads(spark, sf_dir), **FILTER)


def reads_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", "sample_id", "seq", "qual")


ORACLES["reads_derived"] = f"WITH {READS} SELECT read_id, sample_id, seq, qual FROM reads"


def rev_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", S.rc(F.col("seq")).alias("rc"))


ORACLES["rev_comp"] = f"WITH {READS} SELECT read_id, {_RC.format('seq')} AS rc FROM reads"


def expected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.round(S.expected_errors(F.col("qual")), 6).alias("ee"))


ORACLES["expected_errors"] = f"WITH {READS} SELECT read_id, round({_EE.format('qual')}, 6) AS ee FROM reads"


def filter_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir).select("read_id", "sample_id", "seq", "qual")


ORACLES["filter_single"] = f"WITH {FILTERED} SELECT read_id, sample_id, seq, qual FROM filtered"


def filter_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_reads(reads(spark, sf_dir), trunc_q=8, min_len=20, max_n=-1, min_q=3, rm_phix=False).select("read_id", "seq", "qual")


ORACLES["filter_truncated"] = f"""WITH {READS}, c AS (SELECT read_id, seq, qual, length(regexp_extract(qual, '^[^!-\\x29]*')) AS n FROM reads)
SELECT read_id, left(seq, n) AS seq, left(qual, n) AS qual FROM c WHERE n >= 20"""


def _mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = reads(spark, sf_dir)
    return r.select("sample_id", "read_id", F.left("seq", F.lit(40)).alias("seq"), F.left("qual", F.lit(40)).alias("qual")), r.select("sample_id", "read_id", F.left(S.rc(F.col("seq")), F.lit(40)).alias("seq"), F.left(F.reverse("qual"), F.lit(40)).alias("qual"))


def filter_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _mates(spark, sf_dir)
    return R.filter_pairs(f, r, {"min_len": 20, "max_ee": 0.15505}, {"min_len": 20, "max_ee": 0.16505, "trim_left": 1})


ORACLES["filter_paired"] = f"""WITH {READS}, m AS (SELECT sample_id, read_id, left(seq, 40) AS f_seq, left(qual, 40) AS f_qual, substr(left({_RC.format("seq")}, 40), 2) AS r_seq, substr(left(reverse(qual), 40), 2) AS r_qual FROM reads)
SELECT * FROM m WHERE f_seq NOT LIKE '%N%' AND r_seq NOT LIKE '%N%' AND round({_EE.format("f_qual")}, 9) <= 0.15505 AND round({_EE.format("r_qual")}, 9) <= 0.16505 AND {_PHIX.format("f_seq")} < 2 AND {_PHIX.format("r_seq")} < 2"""


def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_stats(reads(spark, sf_dir), filtered(spark, sf_dir))


ORACLES["filter_stats"] = f"WITH {FILTERED} SELECT r.sample_id, count(*) AS reads_in, count(f.read_id) AS reads_out FROM reads r LEFT JOIN filtered f ON r.read_id = f.read_id GROUP BY r.sample_id"


def orient_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.oriented(reads(spark, sf_dir), START).select("read_id", "turned", "seq", "qual")


ORACLES["orient_reads"] = f"""WITH {READS} SELECT read_id, NOT starts_with(seq, '{START}') AS turned, CASE WHEN starts_with(seq, '{START}') THEN seq ELSE {_RC.format("seq")} END AS seq, CASE WHEN starts_with(seq, '{START}') THEN qual ELSE reverse(qual) END AS qual
FROM reads WHERE starts_with(seq, '{START}') OR starts_with({_RC.format("seq")}, '{START}')"""
PRIMER = ("TACGTA", "GTCAGT")


def trim_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remove_primers(reads(spark, sf_dir), *PRIMER, max_mismatch=3).select("read_id", "seq", "qual")


_HAM = "len(list_filter(range(1, length({1}) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1)))"
_FIT = f"({_HAM.format('left({0}, 6)', chr(39) + PRIMER[0] + chr(39))} <= 3 AND {_HAM.format('right({0}, 6)', chr(39) + 'ACTGAC' + chr(39))} <= 3)"
ORACLES["trim_primers"] = f"""WITH {READS}, b AS (SELECT read_id, seq, qual, {_RC.format("seq")} AS r FROM reads), o AS (SELECT read_id, CASE WHEN {_FIT.format("seq")} THEN seq ELSE r END AS seq, CASE WHEN {_FIT.format("seq")} THEN qual ELSE reverse(qual) END AS qual FROM b WHERE {_FIT.format("seq")} OR {_FIT.format("r")})
SELECT read_id, substr(seq, 7, length(seq) - 12) AS seq, substr(qual, 7, length(qual) - 12) AS qual FROM o"""


def phix_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", (S.phix_hits(F.col("seq")) >= 2).alias("is_phix"))


ORACLES["phix_flag"] = f"WITH {READS} SELECT read_id, {_PHIX.format('seq')} >= 2 AS is_phix FROM reads"


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reads(spark, sf_dir).select("seq").distinct()
    return d.select("seq", F.round(S.complexity(F.col("seq")), 6).alias("whole"), F.round(S.complexity(F.col("seq"), window=32, step=8), 6).alias("windowed"))


ORACLES["complexity"] = f"""WITH {READS}, d AS (SELECT DISTINCT seq FROM reads), w AS (SELECT seq, 0 AS s, seq AS part FROM d UNION ALL SELECT seq, u.s + 1, substr(seq, CAST(u.s AS INT) + 1, 32) FROM d, unnest(range(0, 33, 8)) AS u(s)),
k AS (SELECT seq, s, substr(part, CAST(i AS INT), 2) AS kmer FROM w, unnest(range(1, length(part))) AS x(i)), c AS (SELECT seq, s, kmer, count(*) AS n FROM k WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY ALL),
f AS (SELECT seq, s, exp(-sum(p * ln(p))) AS v FROM (SELECT seq, s, n / sum(n) OVER (PARTITION BY seq, s) AS p FROM c) GROUP BY ALL)
SELECT seq, round(max(CASE WHEN s = 0 THEN v END), 6) AS whole, round(min(CASE WHEN s > 0 THEN v END), 6) AS windowed FROM f GROUP BY seq"""


def complexity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity(spark, sf_dir).groupBy(F.floor(F.col("whole") / 0.5).alias("bin")).agg(F.count("*").alias("n"))


ORACLES["complexity_hist"] = f"SELECT CAST(floor(whole / 0.5) AS BIGINT) AS bin, count(*) AS n FROM ({ORACLES['complexity']}) GROUP BY 1"


def derep_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uniques(filtered(spark, sf_dir)).select("sample_id", "uniq_idx", "seq", "abundance")


_RANKED = "SELECT sample_id, seq, abundance, row_number() OVER (PARTITION BY sample_id ORDER BY abundance DESC, seq) - 1 AS uniq_idx FROM uniq"
ORACLES["derep_uniques"] = f"WITH {FILTERED} {_RANKED}"


def derep_quals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.dereplicate(filtered(spark, sf_dir))
    return d.select("sample_id", F.col("uniq_idx").cast("long").alias("uniq_idx"), F.posexplode("quals").alias("pos", "q")).select("sample_id", "uniq_idx", F.col("pos").cast("long").alias("pos"), F.round("q", 6).alias("q"))


ORACLES["derep_quals"] = f"""WITH {FILTERED}, ranked AS ({_RANKED}), q AS (SELECT sample_id, upper(seq) AS seq, i - 1 AS pos, ascii(substr(qual, CAST(i AS INT), 1)) - 33 AS s FROM filtered, unnest(range(1, length(qual) + 1)) AS u(i))
SELECT sample_id, uniq_idx, pos, round(sum(s) / count(*), 6) AS q FROM q JOIN ranked USING (sample_id, seq) GROUP BY ALL"""


def derep_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_map(filtered(spark, sf_dir))


ORACLES["derep_map"] = f"WITH {FILTERED}, ranked AS ({_RANKED}) SELECT sample_id, read_id, uniq_idx FROM filtered JOIN ranked USING (sample_id, seq)"


def top_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uniques(filtered(spark, sf_dir)).filter("uniq_idx < 10").select("sample_id", "uniq_idx", "seq", "abundance")


ORACLES["top_variants"] = f"WITH {FILTERED} SELECT * FROM ({_RANKED}) WHERE uniq_idx < 10"


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_profile(reads(spark, sf_dir)).select("sample_id", F.col("cycle").cast("long").alias("cycle"), "n", F.round("mean_q", 6).alias("mean_q"), "q25", "q50", "q75")


ORACLES["quality_profile"] = f"""WITH {READS}, q AS (SELECT sample_id, i - 1 AS cycle, ascii(substr(qual, CAST(i AS INT), 1)) - 33 AS s FROM reads, unnest(range(1, length(qual) + 1)) AS u(i))
SELECT sample_id, cycle, count(*) AS n, round(avg(s), 6) AS mean_q, quantile_cont(s, 0.25) AS q25, quantile_cont(s, 0.5) AS q50, quantile_cont(s, 0.75) AS q75 FROM q GROUP BY ALL"""


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kmer_counts(templates(spark, sf_dir).select(F.col("tid").alias("seq_id"), F.col("tseq").alias("seq")))


_KMERS = "k AS (SELECT tid AS seq_id, substr(tseq, CAST(i AS INT), 5) AS kmer FROM t, unnest(range(1, length(tseq) - 3)) AS u(i)), c AS (SELECT seq_id, kmer, count(*) AS n FROM k GROUP BY ALL)"
ORACLES["kmer_counts"] = f"WITH {READS}, {_KMERS} SELECT * FROM c"


def kmer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.kmer_distances(templates(spark, sf_dir).select(F.col("tid").alias("seq_id"), F.col("tseq").alias("seq")))
    return d.select("a", "b", F.round("distance", 6).alias("distance"))


ORACLES["kmer_distances"] = f"WITH {READS}, {_KMERS} SELECT x.seq_id AS a, y.seq_id AS b, round(1 - sum(least(x.n, y.n)) / 60, 6) AS distance FROM c x JOIN c y ON x.kmer = y.kmer AND x.seq_id < y.seq_id GROUP BY ALL"


def seqtab_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sequence_table(R.uniques(filtered(spark, sf_dir)))


ORACLES["seqtab_long"] = f"WITH {FILTERED} SELECT * FROM uniq"


def seqtab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = seqtab_long(spark, sf_dir)
    names = T.sample_columns(t)
    w = T.wide(t, names)
    return w.select("seq", F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("counts"), F.lit(len(names)).cast("long").alias("n_samples"))


ORACLES["seqtab_wide"] = f"""WITH {FILTERED}, s AS (SELECT DISTINCT sample_id FROM uniq), q AS (SELECT DISTINCT seq FROM uniq)
SELECT seq, '{{' || string_agg('"' || s.sample_id || '":' || coalesce(abundance, 0), ',' ORDER BY s.sample_id) || '}}' AS counts, count(*) AS n_samples FROM q CROSS JOIN s LEFT JOIN uniq USING (seq, sample_id) GROUP BY seq"""


def seqtab_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ordered_columns(seqtab_long(spark, sf_dir)).select("seq", "total", "n_samples", F.col("column").cast("long").alias("column"))


ORACLES["seqtab_columns"] = f"WITH {FILTERED}, g AS (SELECT seq, CAST(sum(abundance) AS BIGINT) AS total, count(*) AS n_samples FROM uniq GROUP BY seq) SELECT *, row_number() OVER (ORDER BY total DESC, seq) AS \"column\" FROM g"


def seqtab_merge_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = seqtab_long(spark, sf_dir)
    twins = t.filter("abundance > 2").select("sample_id", S.rc(F.col("seq")).alias("seq"), F.floor(F.col("abundance") / 2).alias("abundance"))
    return T.merge_tables([t, twins], try_rc=True)


ORACLES["seqtab_merge_rc"] = f"""WITH {FILTERED}, r AS (SELECT 0 AS table_id, sample_id, seq, abundance FROM uniq UNION ALL SELECT 1, sample_id, {_RC.format("seq")}, CAST(floor(abundance / 2) AS BIGINT) FROM uniq WHERE abundance > 2),
n AS (SELECT seq, sum(abundance) AS n, min(table_id) AS f FROM r GROUP BY seq), p AS (SELECT a.seq, b.seq AS twin FROM n a JOIN n b ON b.seq = {_RC.format("a.seq")} WHERE (-b.n, b.f, b.seq) < (-a.n, a.f, a.seq))
SELECT table_id, sample_id, coalesce(twin, r.seq) AS seq, CAST(sum(abundance) AS BIGINT) AS abundance FROM r LEFT JOIN p ON r.seq = p.seq GROUP BY ALL"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    one = t.select(F.lit("s").alias("sample_id"), F.col("tseq").alias("seq"), (100 + F.col("tid")).alias("abundance"))
    return one.unionByName(t.select(F.lit("s").alias("sample_id"), F.substr("tseq", F.lit(5), F.lit(40)).alias("seq"), (1 + F.col("tid")).alias("abundance")))


_PARTS = "parts AS (SELECT tseq AS seq, 100 + tid AS abundance FROM t UNION ALL SELECT substr(tseq, 5, 40), 1 + tid FROM t)"


def collapse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contained(_parts(spark, sf_dir))


ORACLES["collapse_edges"] = f"WITH {READS}, {_PARTS}, d AS (SELECT DISTINCT seq FROM parts) SELECT a.seq AS inner_seq, b.seq AS outer_seq FROM d a JOIN d b ON a.seq <> b.seq AND contains(b.seq, a.seq)"


def collapse_no_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.collapse(_parts(spark, sf_dir))


ORACLES["collapse_no_mismatch"] = f"""WITH {READS}, {_PARTS}, d AS (SELECT seq, sum(abundance) AS n FROM parts GROUP BY seq), h AS (SELECT a.seq, arg_min(b.seq, (-b.n, b.seq)) AS home FROM d a JOIN d b ON a.seq <> b.seq AND contains(b.seq, a.seq) GROUP BY a.seq)
SELECT 's' AS sample_id, coalesce(home, d.seq) AS seq, CAST(sum(n) AS BIGINT) AS abundance FROM d LEFT JOIN h USING (seq) GROUP BY coalesce(home, d.seq)"""


def shift_denovo(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    cut = lambda at, n, more: t.select(F.substr("tseq", F.lit(at), F.lit(n)).alias("seq"), (F.col("tid") + more).alias("abundance"))
    return shifts(cut(1, 44, 500).unionByName(cut(15, 50, 100)).unionByName(cut(46, 19, 1)))


ORACLES["shift_denovo"] = f"""WITH {READS}, u AS (SELECT seq, sum(n) AS n FROM (SELECT left(tseq, 44) AS seq, tid + 500 AS n FROM t UNION ALL SELECT substr(tseq, 15, 50), tid + 100 FROM t UNION ALL SELECT substr(tseq, 46, 19), tid + 1 FROM t) GROUP BY seq),
ed AS (SELECT DISTINCT a.seq, b.seq AS other FROM u a JOIN u b ON (-b.n, b.seq) < (-a.n, a.seq), unnest(range(20, least(length(a.seq), length(b.seq)))) AS x(k) WHERE right(a.seq, CAST(k AS INT)) = left(b.seq, CAST(k AS INT)) OR left(a.seq, CAST(k AS INT)) = right(b.seq, CAST(k AS INT))),
f AS (SELECT DISTINCT seq FROM ed WHERE other NOT IN (SELECT seq FROM ed))
SELECT u.seq, CAST(n AS BIGINT) AS abundance, f.seq IS NOT NULL AS is_shift FROM u LEFT JOIN f ON u.seq = f.seq"""


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    return t.select(F.concat(F.lit("TTACG"), "tseq", F.lit("GGATC")).alias("seq"), F.concat(F.lit("Genus"), F.floor(F.col("tid") / 2)).alias("genus"), F.concat(F.lit("species"), "tid").alias("species"))


def species_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.species(seqtab_long(spark, sf_dir).select("seq").distinct(), _reference(spark, sf_dir), keep=2)


ORACLES["species_exact"] = f"""WITH {FILTERED}, q AS (SELECT DISTINCT seq FROM uniq), r AS (SELECT 'TTACG' || tseq || 'GGATC' AS ref, 'Genus' || CAST(floor(tid / 2) AS BIGINT) AS genus, 'species' || tid AS species FROM t),
h AS (SELECT q.seq, list_sort(list_distinct(list(genus))) AS g, list_sort(list_distinct(list(species))) AS s FROM q JOIN r ON contains(ref, q.seq) GROUP BY q.seq)
SELECT q.seq, CASE WHEN len(g) = 1 THEN g[1] END AS genus, CASE WHEN len(s) <= 2 THEN array_to_string(s, '/') END AS species FROM q LEFT JOIN h ON q.seq = h.seq"""


def lineage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    part = lambda n: F.floor(F.col("tid") / n)
    line = F.concat(F.lit("K"), part(20), F.lit("; P"), part(10), F.lit(";;C"), part(5), F.lit(";"))
    head = F.when(F.col("tid") % 2 == 0, line).otherwise(F.concat(F.lit("id"), "tid", F.lit(" "), line))
    levels = S.ranks(S.lineage_standard(head), 4)
    unite = S.ranks(S.lineage_unite(F.concat(F.lit("n|a|b|reps|k__K"), part(20), F.lit(";p__unidentified;c__C"), part(5))), 3)
    return t.select("tid", *[levels[i].alias(f"r{i}") for i in range(4)], F.array_join(unite, ";").alias("unite"))


ORACLES["lineage_parse"] = f"""WITH {READS} SELECT tid, CASE WHEN tid % 2 = 0 THEN 'K' || tid // 20 ELSE 'K' || tid // 20 END AS r0, 'P' || tid // 10 AS r1, 'C' || tid // 5 AS r2, CAST(NULL AS VARCHAR) AS r3, 'K' || tid // 20 || ';_UNSPECIFIED;C' || tid // 5 AS unite FROM t"""


def nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts, priors = T.bayes_counts(_reference(spark, sf_dir))
    return counts.join(priors, "kmer").select("genus", "kmer", "n", F.round("prior", 9).alias("prior"))


_NB = "r AS (SELECT tid, 'Genus' || CAST(floor(tid / 2) AS BIGINT) AS genus, 'TTACG' || tseq || 'GGATC' AS seq FROM t), k AS (SELECT DISTINCT tid, genus, substr(seq, CAST(i AS INT), 8) AS kmer FROM r, unnest(range(1, length(seq) - 6)) AS u(i)), c AS (SELECT genus, kmer, count(*) AS n FROM k GROUP BY ALL), p AS (SELECT kmer, (sum(n) + 0.5) / (SELECT count(*) + 1 FROM r) AS prior FROM c GROUP BY kmer)"
ORACLES["nb_train"] = f"WITH {READS}, {_NB} SELECT genus, kmer, n, round(prior, 9) AS prior FROM c JOIN p USING (kmer)"


def nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bayes_best(seqtab_long(spark, sf_dir).select("seq").distinct(), _reference(spark, sf_dir))


ORACLES["nb_classify"] = f"""WITH {FILTERED}, {_NB}, g AS (SELECT genus, count(*) AS m FROM r GROUP BY genus), q AS (SELECT DISTINCT seq AS query FROM uniq WHERE length(seq) >= 50),
w AS (SELECT query, substr(query, CAST(i AS INT), 8) AS kmer, count(*) AS times FROM q, unnest(range(1, length(query) - 6)) AS u(i) GROUP BY ALL), z AS (SELECT query, sum(times) AS size FROM w GROUP BY query),
s AS (SELECT query, genus, sum(times * ln(1 + n / prior)) AS gain FROM w JOIN c USING (kmer) JOIN p USING (kmer) GROUP BY ALL),
o AS (SELECT query, genus, round(gain - size * ln(m + 1), 9) AS score FROM s JOIN g USING (genus) JOIN z USING (query))
SELECT query, arg_min(genus, (-score, genus)) AS genus FROM o GROUP BY query"""


def nb_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bootstrap(seqtab_long(spark, sf_dir).select("seq").distinct(), _reference(spark, sf_dir))


_BOOT = """b AS (SELECT query, rnd, substr(query, CAST(1 + CAST('0x' || left(md5(query || ':' || rnd || ':' || d), 8) AS BIGINT) % (length(query) - 7) AS INT), 8) AS kmer, count(*) AS times FROM q, unnest(range(1, 101)) AS u(rnd), unnest(range(1, CAST(greatest(floor(length(query) / 8), 1) AS BIGINT) + 1)) AS v(d) GROUP BY ALL),
bz AS (SELECT query, rnd, sum(times) AS size FROM b GROUP BY ALL), bs AS (SELECT query, rnd, genus, sum(times * ln(1 + n / prior)) AS gain FROM b JOIN c USING (kmer) JOIN p USING (kmer) GROUP BY ALL),
bo AS (SELECT query, rnd, genus, round(gain - size * ln(m + 1), 9) AS score FROM bs JOIN g USING (genus) JOIN bz USING (query, rnd)), again AS (SELECT query, rnd, arg_min(genus, (-score, genus)) AS other FROM bo GROUP BY ALL)"""
_FULL = ORACLES["nb_classify"].removeprefix("WITH ").replace("SELECT query, arg_min(genus, (-score, genus)) AS genus FROM o GROUP BY query", "full_ AS (SELECT query, arg_min(genus, (-score, genus)) AS genus FROM o GROUP BY query)").replace("\nfull_", ",\nfull_")
ORACLES["nb_bootstrap"] = f"WITH {_FULL}, {_BOOT} SELECT query, genus, count(*) FILTER (WHERE genus = other) AS boot FROM full_ JOIN again USING (query) GROUP BY query, genus"
LEVELS = ("Kingdom", "Phylum", "Class", "Genus")


def _lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda x, n: F.concat(F.lit(x), F.floor(F.col("tid") / n))
    return templates(spark, sf_dir).select(F.concat_ws(";", part("K", 20), part("P", 10), part("C", 5), part("G", 2), F.lit("")).alias("header"), F.concat(F.lit("TTACG"), "tseq", F.lit("GGATC")).alias("seq"))


def taxonomy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assign_taxonomy(seqtab_long(spark, sf_dir).select("seq"), _lineages(spark, sf_dir), LEVELS, min_boot=90)


_LINES = _FULL.replace("'Genus' || CAST(floor(tid / 2) AS BIGINT) AS genus, 'TTACG'", """'{"ranks":["K' || tid // 20 || '","P' || tid // 10 || '","C' || tid // 5 || '","G' || tid // 2 || '"]}' AS genus, 'TTACG'""")
_RANK = "json_extract_string({0}, '$.ranks[{1}]')"
ORACLES["taxonomy_ranks"] = f"""WITH {_LINES}, {_BOOT}, v AS (SELECT query, {", ".join(f"CAST(count(*) FILTER (WHERE " + " AND ".join(f"{_RANK.format('genus', j)} = {_RANK.format('other', j)}" for j in range(k + 1)) + f") AS BIGINT) AS b{k}" for k in range(4))} FROM full_ JOIN again USING (query) GROUP BY query)
SELECT query AS seq, {", ".join(f"CASE WHEN {' AND '.join(f'b{j} >= 90' for j in range(k + 1))} THEN {_RANK.format('genus', k)} END AS {LEVELS[k]}, b{k} AS {LEVELS[k]}_boot" for k in range(4))} FROM full_ JOIN v USING (query)"""


def bimera_ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ungapped_bimeras(seqtab_long(spark, sf_dir))


_LCP = "coalesce(list_position(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, i, 1) = substr({1}, i, 1)), false) - 1, length({0}))"
_BIM = f"""x AS (SELECT q.sample_id, q.seq, {_LCP.format("q.seq", "p.seq")} AS l, {_LCP.format("reverse(q.seq)", "reverse(p.seq)")} AS r FROM uniq q JOIN uniq p ON q.sample_id = p.sample_id AND p.abundance > 1.5 * q.abundance AND p.abundance >= 2 AND length(p.seq) = length(q.seq)),
f AS (SELECT sample_id, seq, max(l) + max(r) >= length(seq) AS flag FROM x WHERE l + r < length(seq) GROUP BY sample_id, seq), flags AS (SELECT u.sample_id, u.seq, abundance, coalesce(flag, false) AS flag FROM uniq u LEFT JOIN f ON u.sample_id = f.sample_id AND u.seq = f.seq)"""
ORACLES["bimera_ungapped"] = f"WITH {FILTERED}, {_BIM} SELECT * FROM flags"


def bimera_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consensus(bimera_ungapped(spark, sf_dir))


ORACLES["bimera_consensus"] = f"WITH {FILTERED}, {_BIM}, n AS (SELECT seq, count(*) AS nsam, count(*) FILTER (WHERE flag) AS nflag FROM flags GROUP BY seq) SELECT *, nflag > 0 AND (nflag >= nsam OR nflag >= (nsam - 1) * 0.9) AS is_chimera FROM n"


def bimera_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.remove_bimeras(seqtab_long(spark, sf_dir), "pooled")


ORACLES["bimera_pooled"] = f"WITH {FILTERED.replace('uniq AS (SELECT sample_id, upper(seq)', 'each AS (SELECT sample_id, upper(seq)')}, uniq AS (SELECT 'all' AS sample_id, seq, sum(abundance) AS abundance FROM each GROUP BY seq), {_BIM} SELECT * FROM each WHERE seq NOT IN (SELECT seq FROM flags WHERE flag)"


def bimera_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.remove_bimeras(seqtab_long(spark, sf_dir), "per-sample")


ORACLES["bimera_per_sample"] = f"WITH {FILTERED}, {_BIM} SELECT sample_id, seq, abundance FROM flags WHERE NOT flag"


def hamming_ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    return reads(spark, sf_dir).join(F.broadcast(t), "tid").select("read_id", S.hamming(F.col("seq"), F.col("tseq")).cast("long").alias("distance"))


ORACLES["hamming_ungapped"] = f"WITH {READS} SELECT read_id, CAST({_HAM.format('seq', 'tseq')} AS BIGINT) AS distance FROM reads JOIN t USING (tid)"


def uniques_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = R.uniques(filtered(spark, sf_dir))
    return u.select("sample_id", F.concat(F.lit(">sq"), F.col("uniq_idx") + 1, F.lit(";size="), "abundance", F.lit(";\n"), "seq").alias("entry"))


ORACLES["uniques_fasta"] = f"WITH {FILTERED} SELECT sample_id, '>sq' || (uniq_idx + 1) || ';size=' || abundance || ';' || chr(10) || seq AS entry FROM ({_RANKED})"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all kinds that an assigned genus can have, and a header."""
    n = F.col("tid")
    genus = F.concat(F.lit("Genus"), n)
    tax = F.when(n % 6 == 0, genus).when(n % 6 == 1, F.concat(genus, F.lit("/Other"))).when(n % 6 == 2, F.concat(F.lit("Other/"), genus)).when(n % 6 == 3, F.concat(genus, F.lit("x"))).when(n % 6 == 4, F.concat(genus, F.lit("_1")))
    header = F.when(n % 3 == 0, F.concat(F.lit("id  "), genus, F.lit(" sp"), n)).when(n % 3 == 1, F.concat(F.lit("id "), genus)).otherwise("id")
    return templates(spark, sf_dir).select("tid", "tseq", genus.alias("genus"), tax.alias("tax"), header.alias("header"))


_NAMED = "nm AS (SELECT tid, tseq, 'Genus' || tid AS genus, CASE tid % 6 WHEN 0 THEN 'Genus' || tid WHEN 1 THEN 'Genus' || tid || '/Other' WHEN 2 THEN 'Other/Genus' || tid WHEN 3 THEN 'Genus' || tid || 'x' WHEN 4 THEN 'Genus' || tid || '_1' END AS tax FROM t)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    g, s = S.genus_species(F.col("header"))
    folded = S.fold_escherichia(F.when(F.col("tid") % 2 == 0, "Shigella flexneri").otherwise(F.col("genus")))
    return n.select("tid", S.genus_matches(F.col("tax"), F.col("genus")).alias("matches"), g.alias("g"), s.alias("s"), folded.alias("folded"), S.count_text(F.col("tid") * 12_300 + F.col("tid") * F.col("tid") * 1_000).alias("said"), S.codes(F.concat("tseq", F.lit("N-x"))).alias("codes"))


ORACLES["names"] = f"""WITH {READS}, {_NAMED}, c AS (SELECT *, tid * 12300 + tid * tid * 1000 AS n FROM nm)
SELECT tid, tid % 6 IN (0, 1, 2, 4) AS matches, CASE WHEN tid % 3 < 2 THEN genus ELSE '' END AS g, CASE WHEN tid % 3 = 0 THEN 'sp' || tid ELSE '' END AS s, CASE WHEN tid % 2 = 0 THEN 'Escherichia/Shigella' ELSE genus END AS folded,
  CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS said, translate(tseq, 'ACGT', '1234') || '590' AS codes FROM c"""


def species_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    refs = n.select(F.concat(F.lit("TTACG"), "tseq", F.lit("GGATC")).alias("seq"), "genus", F.concat(F.lit("species"), "tid").alias("species"))
    return T.add_species(n.select(F.col("tseq").alias("seq"), F.col("tax").alias("Genus")), refs)


ORACLES["species_added"] = f"WITH {READS}, {_NAMED} SELECT tseq AS seq, tax AS Genus, CASE WHEN tid % 6 IN (0, 1, 2, 4) THEN 'species' || tid END AS Species FROM nm"


def unite_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    return spark.createDataFrame([("plain", T.is_unite(n)), ("unite", T.is_unite(n.withColumn("header", F.concat("header", F.lit("|SH1.1FU|reps|k__Fungi")))))], "kind string, found boolean")


ORACLES["unite_headers"] = "SELECT 'plain' AS kind, false AS found UNION ALL SELECT 'unite', true"


def ordered_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - the share of equal 5-mers at equal positions, of reads and their amplicons."""
    r = reads(spark, sf_dir).join(F.broadcast(templates(spark, sf_dir)), "tid")
    return r.select("read_id", F.round(S.ordered_distance(F.col("seq"), F.col("tseq")), 6).alias("distance"))


ORACLES["ordered_distances"] = f"WITH {READS} SELECT read_id, round(1 - len(list_filter(range(1, 61), lambda i: substr(seq, i, 5) = substr(tseq, i, 5))) / 60, 6) AS distance FROM reads JOIN t USING (tid)"


def gapless_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reads differ from the first 60 letters of their amplicons, letter against letter."""
    r = reads(spark, sf_dir).join(F.broadcast(templates(spark, sf_dir)), "tid")  # 40 rows
    x, y = S.gapless(F.left("tseq", F.lit(60)), F.col("seq"))
    return r.select("read_id", x.alias("x"), y.alias("y")).select("read_id", F.inline(S.substitutions(F.col("x"), F.col("y"))))


ORACLES["gapless_substitutions"] = f"WITH {READS}, w AS (SELECT read_id, i - 1 AS pos, substr(tseq, CAST(i AS INT), 1) AS from_nt, substr(seq, CAST(i AS INT), 1) AS to_nt FROM reads JOIN t USING (tid), unnest(range(1, 61)) AS u(i)) SELECT * FROM w WHERE from_nt <> to_nt AND from_nt <> 'N' AND to_nt <> 'N' AND to_nt <> '' AND from_nt <> ''"


def distinct_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences_of(spark, reads(spark, sf_dir).withColumn("seq", F.lower("seq")), collapse=True)


ORACLES["distinct_sequences"] = f"WITH {READS} SELECT DISTINCT upper(seq) AS seq FROM reads"


def cycled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark case: the reads in turn until 2,000,000 bases are reached."""
    return R.cycled(reads(spark, sf_dir).filter("read_id < 500").select("read_id", "sample_id", "seq", "qual"), 2_000_000)


ORACLES["cycled_reads"] = f"""WITH {READS}, s AS (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS k, sum(length(seq)) OVER (ORDER BY read_id) AS upto FROM reads WHERE read_id < 500), z AS (SELECT count(*) AS n, sum(length(seq)) AS bases FROM s)
SELECT CAST(c * n + k AS BIGINT) AS read_id, sample_id, seq, qual FROM s, z, unnest(range(0, CAST(ceil(2000000 / bases) AS BIGINT))) AS u(c) WHERE c * bases + upto - length(seq) < 2000000"""


def rank_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir).select(F.substr("tseq", F.lit(3), F.lit(LENGTH - 4)).alias("seq"), "genus", "tax").dropDuplicates(["seq"])
    return T.rank_totals(seqtab_long(spark, sf_dir), n.withColumn("tax", F.when(F.col("tax").contains("x"), "").otherwise(F.col("tax"))), ["genus", "tax"])


ORACLES["rank_totals"] = f"""WITH {FILTERED}, {_NAMED}, l AS (SELECT DISTINCT ON (seq) substr(tseq, 3, 60) AS seq, genus, CASE WHEN tax LIKE '%x%' THEN '' ELSE tax END AS tax FROM nm), j AS (SELECT abundance, genus, tax FROM uniq LEFT JOIN l USING (seq))
SELECT 'genus' AS stage, CAST(coalesce(sum(abundance) FILTER (WHERE coalesce(genus, '') <> ''), 0) AS BIGINT) AS n FROM j UNION ALL SELECT 'tax', CAST(coalesce(sum(abundance) FILTER (WHERE coalesce(tax, '') <> ''), 0) AS BIGINT) FROM j"""


def oriented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _mates(spark, sf_dir)
    return R.filter_pairs(f, r, {"min_len": 20, "rm_phix": False, "max_len": 40}, {"min_len": 20, "rm_phix": False}, orient=START)


ORACLES["oriented_pairs"] = f"""WITH {READS}, m AS (SELECT sample_id, read_id, left(seq, 40) AS f, left(qual, 40) AS fq, left({_RC.format("seq")}, 40) AS r, left(reverse(qual), 40) AS rq FROM reads), o AS (SELECT *, starts_with(f, '{START}') AS ahead, starts_with({_RC.format("f")}, '{START}') AS behind FROM m)
SELECT sample_id, read_id, CASE WHEN ahead THEN f ELSE {_RC.format("f")} END AS f_seq, CASE WHEN ahead THEN fq ELSE reverse(fq) END AS f_qual, CASE WHEN ahead THEN r ELSE {_RC.format("r")} END AS r_seq, CASE WHEN ahead THEN rq ELSE reverse(rq) END AS r_qual FROM o WHERE (ahead OR behind) AND f NOT LIKE '%N%' AND r NOT LIKE '%N%'"""


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ, a file for each sample in the order of the reads, and read again."""
    register(spark)
    r = reads(spark, sf_dir).select("sample_id", "read_id", F.concat(F.lit("@"), "read_id").alias("header"), "seq", F.lit("+").alias("sep"), "qual")
    path = shared_path(spark)
    r.repartition("sample_id").sortWithinPartitions("sample_id", "read_id").write.format("fastq").option("bySample", "true").option("samples", "none").mode("overwrite").save(path)
    return spark.read.format("fastq").load(path).select("sample_id", "read_id", "header", "seq", "qual")


ORACLES["fastq_round_trip"] = f"WITH {READS} SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY read_id) - 1 AS read_id, '@' || read_id AS header, seq, qual FROM reads"


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_path(spark)
    uniques_of = R.uniques(filtered(spark, sf_dir)).select(F.concat("sample_id", F.lit("."), F.col("uniq_idx") + 1, F.lit(";size="), "abundance", F.lit(";")).alias("header"), F.lower("seq").alias("seq"))
    uniques_of.write.format("fasta").mode("overwrite").save(path)
    return spark.read.format("fasta").load(path).select("header", "seq")


ORACLES["fasta_round_trip"] = f"WITH {FILTERED} SELECT sample_id || '.' || (uniq_idx + 1) || ';size=' || abundance || ';' AS header, seq FROM ({_RANKED})"


def track_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = seqtab_long(spark, sf_dir)
    bad = bimera_consensus(spark, sf_dir).filter("is_chimera").select("seq")
    return T.track([("input", reads(spark, sf_dir), None), ("filtered", filtered(spark, sf_dir), None), ("table", t, "abundance"), ("nochim", t.join(bad, "seq", "left_anti"), "abundance")]).select(F.col("stage_order").cast("long").alias("stage_order"), "stage", "n")


_TRACK = f"{FILTERED}, {_BIM}, nn AS (SELECT seq, count(*) AS nsam, count(*) FILTER (WHERE flag) AS nflag FROM flags GROUP BY seq), bad AS (SELECT seq FROM nn WHERE nflag > 0 AND (nflag >= nsam OR nflag >= (nsam - 1) * 0.9)), tr AS (SELECT CAST(0 AS BIGINT) AS stage_order, 'input' AS stage, count(*) AS n FROM reads UNION ALL SELECT 1, 'filtered', count(*) FROM filtered UNION ALL SELECT 2, 'table', CAST(sum(abundance) AS BIGINT) FROM uniq UNION ALL SELECT 3, 'nochim', CAST(coalesce(sum(abundance), 0) AS BIGINT) FROM uniq WHERE seq NOT IN (SELECT seq FROM bad))"
ORACLES["track_reads"] = f"WITH {_TRACK} SELECT * FROM tr"


def sankey_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sankey_links(track_reads(spark, sf_dir))


ORACLES["sankey_links"] = f"""WITH {_TRACK}, l AS (SELECT stage AS source, lead(stage) OVER w AS nxt, n, lead(n) OVER w AS m FROM tr WINDOW w AS (ORDER BY stage_order))
SELECT source, nxt AS target, least(n, m) AS value FROM l WHERE nxt IS NOT NULL UNION ALL SELECT source, 'lost', n - m FROM l WHERE nxt IS NOT NULL AND n > m"""


def learn_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.learning_subset(R.uniques(filtered(spark, sf_dir)), 100_000)


ORACLES["learn_subset"] = f"""WITH {FILTERED}, b AS (SELECT sample_id, CAST(sum(abundance * length(seq)) AS BIGINT) AS bases FROM uniq GROUP BY sample_id), c AS (SELECT *, coalesce(sum(bases) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT sample_id, bases FROM c WHERE before < 100000"""


def trans_ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of reads against their templates, position by position."""
    r = reads(spark, sf_dir).filter("h < 250 OR h >= 330").join(F.broadcast(templates(spark, sf_dir)), "tid")
    each = r.select(F.posexplode(F.split("tseq", "")).alias("pos", "from_nt"), "seq", "qual")
    at = lambda c: F.substr(c, F.col("pos") + 1, F.lit(1))
    each = each.select("from_nt", at(F.col("seq")).alias("to_nt"), (F.ascii(at(F.col("qual"))) - 33).cast("long").alias("q"))
    return each.groupBy("from_nt", "to_nt", "q").agg(F.count("*").alias("n"))


_TRANS = "w AS (SELECT seq, qual, tseq FROM reads JOIN t USING (tid) WHERE h < 250 OR h >= 330), tr AS (SELECT substr(tseq, CAST(i AS INT), 1) AS from_nt, substr(seq, CAST(i AS INT), 1) AS to_nt, CAST(ascii(substr(qual, CAST(i AS INT), 1)) - 33 AS BIGINT) AS q, count(*) AS n FROM w, unnest(range(1, 65)) AS u(i) GROUP BY ALL)"
ORACLES["trans_ungapped"] = f"WITH {READS}, {_TRANS} SELECT * FROM tr"


def err_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("from_nt", "q"))
    return trans_ungapped(spark, sf_dir).select("from_nt", "to_nt", "q", F.round(F.col("n") / total, 9).alias("rate"), F.round(S.nominal(F.col("q")), 9).alias("nominal"))


ORACLES["err_observed"] = f"WITH {READS}, {_TRANS} SELECT from_nt, to_nt, q, round(n / sum(n) OVER (PARTITION BY from_nt, q), 9) AS rate, round(power(10.0, -q / 10.0), 9) AS nominal FROM tr"


def err_noqual(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trans_ungapped(spark, sf_dir).groupBy("from_nt", "to_nt").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("from_nt"))
    return n.select("from_nt", "to_nt", F.round(rate, 9).alias("rate"), F.round(S.inflate(rate, 3.0), 9).alias("inflated"))


ORACLES["err_noqual"] = f"WITH {READS}, {_TRANS}, g AS (SELECT from_nt, to_nt, sum(n) AS n FROM tr GROUP BY ALL), r AS (SELECT from_nt, to_nt, n / sum(n) OVER (PARTITION BY from_nt) AS r FROM g) SELECT from_nt, to_nt, round(r, 9) AS rate, round(least(greatest(r * 3 / (1 + 2 * r), 0), 1), 9) AS inflated FROM r"


def _matrix(trans: DataFrame) -> np.ndarray:
    """At most 16 x Q counts, from their aggregate."""
    rows = trans.groupBy("from_nt", "to_nt", "q").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((16, 1 + max((r.q for r in rows), default=40)), np.int64)
    for r in rows:
        out["ACGT".index(r.from_nt) * 4 + "ACGT".index(r.to_nt), r.q] = r.n
    return out


def err_loess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.error_rows(spark, loess_errors(_matrix(trans_ungapped(spark, sf_dir))))


BINS = (8, 20, 30, 40)


def err_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.error_rows(spark, binned_errors(list(BINS))(_matrix(trans_ungapped(spark, sf_dir)))).withColumn("rate", F.round("rate", 9))


_PAIRS = "nt(x) AS (VALUES ('A'), ('C'), ('G'), ('T')), ch AS (SELECT a.x AS from_nt, b.x AS to_nt FROM nt a, nt b)"
ORACLES["err_binned"] = f"""WITH {READS}, {_TRANS}, {_PAIRS}, bins(bin) AS (VALUES {", ".join(f"({b})" for b in BINS)}), z AS (SELECT from_nt, q, sum(n) AS total FROM tr GROUP BY ALL),
o AS (SELECT ch.from_nt, ch.to_nt, bin, coalesce(tr.n / z.total, 0) AS rate FROM ch CROSS JOIN bins LEFT JOIN tr ON tr.from_nt = ch.from_nt AND tr.to_nt = ch.to_nt AND tr.q = bin LEFT JOIN z ON z.from_nt = ch.from_nt AND z.q = bin),
s AS (SELECT q, coalesce(max(bin) FILTER (WHERE bin <= q), min(bin)) AS lo, coalesce(min(bin) FILTER (WHERE bin >= q), max(bin)) AS hi FROM range(0, (SELECT max(q) + 1 FROM tr)) AS u(q), bins GROUP BY q),
v AS (SELECT a.from_nt, a.to_nt, s.q, least(greatest(a.rate + CASE WHEN hi > lo THEN (b.rate - a.rate) * (s.q - lo) / (hi - lo) ELSE 0 END, {LEAST}), {MOST}) AS rate FROM s JOIN o a ON a.bin = lo JOIN o b ON b.bin = hi AND b.from_nt = a.from_nt AND b.to_nt = a.to_nt WHERE a.from_nt <> a.to_nt)
SELECT from_nt, to_nt, q, round(rate, 9) AS rate FROM v UNION ALL SELECT from_nt, from_nt, q, round(1 - sum(rate), 9) FROM v GROUP BY from_nt, q"""


def learned_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.error_rows(spark, D.learn_errors(R.dereplicate(filtered(spark, sf_dir))))


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    err = loess_errors(_matrix(trans_ungapped(spark, sf_dir)))
    return D.denoise(R.dereplicate(filtered(spark, sf_dir)), err)


def birth_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.birth_substitutions(R.dereplicate(filtered(spark, sf_dir)), loess_errors(_matrix(trans_ungapped(spark, sf_dir))))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.profiles(R.dereplicate(filtered(spark, sf_dir)), loess_errors(_matrix(trans_ungapped(spark, sf_dir))))


def positional_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.substitutions(_profile(spark, sf_dir))


def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cluster_quality(_profile(spark, sf_dir))


def denoised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of both mates to unique sequences, to clusters, to merged pairs."""
    f, r = _mates(spark, sf_dir)
    err = loess_errors(_matrix(trans_ungapped(spark, sf_dir)))
    return D.merge_denoised(R.filter_reads(f, max_ee=1), R.filter_reads(r, max_ee=1), err, err)


def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _mates(spark, sf_dir)
    clean = lambda d: d.filter(~F.col("seq").contains("N"))
    return D.merge_pairs(clean(f), clean(r))


ORACLES["merged_pairs"] = f"""WITH {READS}, m AS (SELECT sample_id, seq, left(seq, 40) AS forward, left({_RC.format("seq")}, 40) AS reverse FROM reads)
SELECT sample_id, seq, forward, reverse, count(*) AS abundance, 80 - length(seq) AS nmatch, CAST(0 AS BIGINT) AS nmismatch, CAST(0 AS BIGINT) AS nindel, true AS accept FROM m WHERE NOT contains(forward, 'N') AND NOT contains(reverse, 'N') GROUP BY ALL"""


def merged_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _mates(spark, sf_dir)
    return D.merge_pairs(f, r, just_concatenate=True).select("sample_id", "seq", "abundance", "accept")


ORACLES["merged_concatenated"] = f"WITH {READS}, m AS (SELECT sample_id, left(seq, 40) AS f, left({_RC.format('seq')}, 40) AS r FROM reads) SELECT sample_id, f || 'NNNNNNNNNN' || {_RC.format('r')} AS seq, count(*) AS abundance, true AS accept FROM m GROUP BY sample_id, f, r"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    u = t.select(F.pmod(F.col("tid") + 1, F.lit(40)).alias("tid"), F.col("tseq").alias("b"))
    return D.aligned(t.join(u, "tid").select(F.col("tseq").alias("a"), "b"))


def bimera_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consensus(D.bimeras(seqtab_long(spark, sf_dir)))


def _own() -> dict:
    names = {"filtered", "reads", "templates", "queries", "oracle_sql", "register", "sequences_of", "shared_path", "shifts"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in names}


def queries() -> dict:
    return _own()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
