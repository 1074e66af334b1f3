"""Sequence tables in long form (sample_id, seq, abundance) and what is computed from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from .resolve import homes, saved


def sequence_table(uniques: DataFrame) -> DataFrame:
    return uniques.groupBy("sample_id", "seq").agg(F.sum("abundance").alias("abundance"))


def ordered_columns(table: DataFrame, by: str = "abundance") -> DataFrame:
    """Sequences with totals, in the order of a wide table's columns.

    Ranges of the order are numbered each by itself, after the sizes of those before (a row a range), so no task sees all.
    """
    total = table.groupBy("seq").agg(F.sum("abundance").alias("total"), F.count_if(F.col("abundance") > 0).alias("n_samples"))
    order = [F.desc("total" if by == "abundance" else "n_samples"), F.asc("seq")]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(total.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("size")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(sizes), "_range").select("seq", "total", "n_samples", (F.col("_before") + F.col("_place")).alias("column"))


def sample_columns(table: DataFrame, most: int = 10_000) -> list[str]:
    """The samples of a table, for the columns of a wide one; an error if there are too many for a row."""
    names = sorted(r.sample_id for r in table.select("sample_id").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"a wide table of more than {most} samples: keep it long")
    return names


def wide(table: DataFrame, samples: list[str]) -> DataFrame:
    """A row per sequence, a column per sample (0 if absent): sequences stay rows, so width is bounded by the samples."""
    return table.groupBy("seq").pivot("sample_id", samples).agg(F.sum("abundance")).fillna(0)


def merge_tables(tables: list[DataFrame], try_rc: bool = False) -> DataFrame:
    """Rows of all tables by table and sample. With ``try_rc`` twins take the orientation of the larger total (ties: the one of the earlier table, then the lesser)."""
    rows = None
    for k, t in enumerate(tables):
        t = t.select(F.lit(k).alias("table_id"), "sample_id", "seq", "abundance")
        rows = t if rows is None else rows.unionByName(t)
    if try_rc:
        total = rows.groupBy("seq").agg(F.sum("abundance").alias("n"), F.min("table_id").alias("first"))
        twin = total.select(S.rc(F.col("seq")).alias("seq"), F.col("seq").alias("twin"), F.col("n").alias("m"), F.col("first").alias("other"))
        rank = F.struct(-F.col("n"), "first", "seq") <= F.struct(-F.col("m"), F.col("other"), F.col("twin"))
        pick = total.join(twin, "seq").filter(~rank).select("seq", "twin")
        rows = rows.join(pick, "seq", "left").withColumn("seq", F.coalesce("twin", "seq"))
    return rows.groupBy("table_id", "sample_id", "seq").agg(F.sum("abundance").alias("abundance"))


def held(inner: DataFrame, outer: DataFrame, k: int = 16) -> DataFrame:
    """Pairs (inner, outer) of the distinct sequences of both (seq) of which the second holds the first, itself included.

    An inner sequence of ``k`` letters and more meets the outer ones that hold its rarest k-mer (ties: the least), so there is no
    hot key where all begin with one primer. Shorter ones meet those that hold them as a word. Empty and null ones meet none.
    """
    words = lambda c, n: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, n))))
    a, b = inner.select(F.col("seq").alias("inner")).distinct(), outer.select(F.col("seq").alias("outer")).distinct()
    some = b.filter(F.length("outer") >= k).select("outer", words("outer", F.lit(k)).alias("word"))
    n = some.groupBy("word").agg(F.count("*").alias("n"))
    asked = a.filter(F.length("inner") >= k).select("inner", words("inner", F.lit(k)).alias("word")).join(n, "word", "left")
    rare = asked.groupBy("inner").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    long = rare.join(some, "word").filter(F.contains("outer", "inner")).select("inner", "outer")
    short = a.filter(F.length("inner").between(1, k - 1))
    sizes = F.broadcast(short.select(F.length("inner").alias("size")).distinct())  # fewer than k rows
    cut = b.filter(F.length("outer") >= 1).select("outer", F.explode(F.sequence(F.lit(1), F.least(F.length("outer"), F.lit(k - 1)))).alias("size")).join(sizes, "size")
    return long.unionByName(short.join(cut.select("outer", words("outer", F.col("size")).alias("inner")), "inner").select("inner", "outer"))


def contained(seqs: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of different sequences of which one holds the other."""
    return held(seqs, seqs).filter(F.col("inner") != F.col("outer")).select(F.col("inner").alias("inner_seq"), F.col("outer").alias("outer_seq"))


def collapse(table: DataFrame) -> DataFrame:
    """Merge sequences of which one holds the other: in descending totals (ties: the lesser first), each goes to the first that holds it or that it holds, under the longest name."""
    total = table.groupBy("seq").agg(F.sum("abundance").alias("total"))
    to = homes(total, contained(table).toDF("a", "b"))
    return table.join(to, "seq", "left").groupBy("sample_id", F.coalesce("to", "seq").alias("seq")).agg(F.sum("abundance").alias("abundance"))


def track(stages: list[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """Reads at each stage: (name, frame, weight column or None to count rows)."""
    out = None
    for k, (name, df, weight) in enumerate(stages):
        n = df.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("n") if weight else F.count("*").alias("n")).select(F.lit(k).alias("stage_order"), F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def sankey_links(tracked: DataFrame) -> DataFrame:
    """Links between stages: what stays, and what is lost where anything is."""
    order = Window.orderBy("stage_order")
    pair = tracked.select(F.col("stage").alias("source"), F.lead("stage").over(order).alias("next"), "n", F.lead("n").over(order).alias("m")).filter("next IS NOT NULL")
    kept = pair.select("source", F.col("next").alias("target"), F.least("n", "m").alias("value"))
    return kept.unionByName(pair.filter("n > m").select("source", F.lit("lost").alias("target"), (F.col("n") - F.col("m")).alias("value")))


def ungapped_bimeras(table: DataFrame, min_fold: float = 1.5, min_abund: int = 2) -> DataFrame:
    """Per sample and sequence of one length: is it the prefix of one more abundant sequence and the suffix of another?"""
    q = table.select("sample_id", "seq", "abundance")
    p = q.select("sample_id", F.col("seq").alias("parent"), F.col("abundance").alias("n"))
    same = F.zip_with(F.split("seq", ""), F.split("parent", ""), lambda a, b: a == b)
    pairs = q.join(p, "sample_id").filter((F.col("n") > min_fold * F.col("abundance")) & (F.col("n") >= min_abund) & (F.length("seq") == F.length("parent"))).withColumn("same", same)
    size = F.length("seq")
    off = F.array_position("same", False)
    left = F.when(off == 0, size).otherwise(off - 1)
    back = F.array_position(F.reverse(F.col("same")), False)
    right = F.when(back == 0, size).otherwise(back - 1)
    cover = pairs.withColumns({"left": left, "right": right}).filter(F.col("left") + F.col("right") < size)
    flags = cover.groupBy("sample_id", "seq").agg((F.max("left") + F.max("right") >= F.first(size)).alias("flag"))
    return q.join(flags, ["sample_id", "seq"], "left").select("sample_id", "seq", "abundance", F.coalesce("flag", F.lit(False)).alias("flag"))


def consensus(flags: DataFrame, min_sample_fraction: float = 0.9, ignore_n_negatives: int = 1) -> DataFrame:
    """Sequence by sequence: samples, samples that flag it, and whether it is a chimera."""
    n = flags.groupBy("seq").agg(F.count("*").alias("nsam"), F.count_if("flag").alias("nflag"))
    enough = (F.col("nflag") >= F.col("nsam")) | (F.col("nflag") >= (F.col("nsam") - ignore_n_negatives) * min_sample_fraction)
    return n.withColumn("is_chimera", (F.col("nflag") > 0) & enough)


def remove_bimeras(table: DataFrame, method: str = "consensus", flags: Callable[[DataFrame], DataFrame] = ungapped_bimeras, **options) -> DataFrame:
    """The table without chimeras: by consensus of the samples, of all samples pooled, or each sample's own."""
    if method == "per-sample":
        return table.join(flags(table).filter("flag").select("sample_id", "seq"), ["sample_id", "seq"], "left_anti")
    if method == "pooled":
        one = table.groupBy("seq").agg(F.sum("abundance").alias("abundance")).withColumn("sample_id", F.lit("all"))
        bad = flags(one).filter("flag")
    elif method == "consensus":
        bad = consensus(flags(table), **options).filter("is_chimera")
    else:
        raise ValueError(f"no such method: {method}")
    return table.join(bad.select("seq"), "seq", "left_anti")


def species(queries: DataFrame, refs: DataFrame, keep: float = 1, try_rc: bool = False) -> DataFrame:
    """Exact species: queries (seq) that are part of a reference (seq, genus, species). keep: most species to name."""
    q = queries.select("seq").distinct()
    asked = q.select("seq", F.col("seq").alias("as_read"))
    if try_rc:
        asked = asked.unionByName(q.select("seq", S.rc(F.col("seq")).alias("as_read")))
    r = refs.select(F.col("seq").alias("ref"), S.fold_escherichia(F.col("genus")).alias("genus"), "species").distinct()
    pairs = held(asked.select(F.col("as_read").alias("seq")), r.select(F.col("ref").alias("seq"))).toDF("as_read", "ref")
    hits = asked.join(pairs, "as_read").join(r, "ref").select("seq", (F.col("seq") == F.col("as_read")).alias("ahead"), "genus", "species")
    ahead = hits.groupBy("seq").agg(F.max("ahead").alias("any_ahead"))
    hits = hits.join(ahead, "seq").filter(F.col("ahead") == F.col("any_ahead"))
    g, s = F.array_sort(F.collect_set("genus")), F.array_sort(F.collect_set("species"))
    named = hits.groupBy("seq").agg(F.when(F.size(g) == 1, g[0]).alias("genus"), F.when(F.size(s) <= keep, F.array_join(s, "/")).alias("species"))
    return q.join(named, "seq", "left").select("seq", "genus", "species")


def add_species(taxa: DataFrame, refs: DataFrame, column: str = "Genus", keep: float = 1, try_rc: bool = False) -> DataFrame:
    """``taxa(seq, ...)`` with Species: the exact species where its genus agrees with the one assigned."""
    found = species(taxa, refs, keep, try_rc).select("seq", F.col("genus").alias("_genus"), F.col("species").alias("_species"))
    fits = S.genus_matches(F.col(column), F.col("_genus"))
    kept = [c for c in taxa.columns if c.lower() != "species"]
    return taxa.select(*kept).join(found, "seq", "left").select(*kept, F.when(fits, F.col("_species")).alias("Species"))


def bayes_counts(refs: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Naive Bayes training of refs(genus, seq): references of each genus, of each (genus, k-mer), and priors of k-mers."""
    genera = refs.groupBy("genus").agg(F.count("*").alias("n_refs"))
    seen = refs.select("genus", F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("kmer"))
    counts = seen.groupBy("genus", "kmer").agg(F.count("*").alias("n"))
    total = refs.agg(F.count("*").alias("all_refs"))
    priors = counts.groupBy("kmer").agg(F.sum("n").alias("m")).crossJoin(F.broadcast(total)).select("kmer", ((F.col("m") + 0.5) / (F.col("all_refs") + 1)).alias("prior"))
    return genera, counts, priors


def bayes_best(queries: DataFrame, refs: DataFrame, k: int = 8, draws: DataFrame | None = None) -> DataFrame:
    """The best genus of each query (ties: the least name), from k-mers with multiplicity. Queries of under 50 letters have none.

    Uses sum(log p) = sum(log prior) - L log(n + 1) + sum over known k-mers of log(1 + c / prior), so only known pairs are joined.
    """
    genera, counts, priors = bayes_counts(refs, k)
    q = draws if draws is not None else queries.filter(F.length("seq") >= 50).select(F.col("seq").alias("query"), F.explode(S.kmers(F.col("seq"), k)).alias("kmer"))
    keys = [c for c in q.columns if c != "kmer"]
    times = q.groupBy(*keys, "kmer").agg(F.count("*").alias("times"))
    size = times.groupBy(*keys).agg(F.sum("times").alias("size"))
    gain = times.join(counts.join(priors, "kmer"), "kmer").groupBy(*keys, "genus").agg(F.sum(F.col("times") * F.log1p(F.col("n") / F.col("prior"))).alias("gain"))
    score = gain.join(genera, "genus").join(size, keys).withColumn("score", F.round(F.col("gain") - F.col("size") * F.ln(F.col("n_refs") + 1), 9))
    best = score.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "genus")).alias("b")).select(*keys, "b.genus")
    return best if draws is not None else queries.select(F.col("seq").alias("query")).distinct().join(best, "query", "left")


def resampled(queries: DataFrame, refs: DataFrame, rounds: int = 100, k: int = 8) -> DataFrame:
    """(query, round, genus) of ``rounds`` draws of an eighth of a query's k-mers; draws are keyed by content (MD5), so they do not depend on partitioning."""
    long = queries.select(F.col("seq").alias("query")).distinct().filter(F.length("query") >= 50).select("query", S.kmers(F.col("query"), k).alias("words")).filter(F.size("words") > 0)
    n = F.greatest(F.floor(F.length("query") / 8), F.lit(1)).cast("int")
    drawn = long.select("query", "words", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), n.alias("n"))
    at = lambda d: (F.conv(F.left(F.md5(F.concat_ws(":", "query", "round", d)), F.lit(8)), 16, 10).cast("long") % F.size("words")).cast("int")
    drawn = drawn.select("query", "round", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda d: F.get(F.col("words"), at(d)))).alias("kmer"))
    return bayes_best(queries, refs, k, drawn)


def bootstrap(queries: DataFrame, refs: DataFrame, rounds: int = 100, k: int = 8) -> DataFrame:
    """Agreement of ``rounds`` resampled assignments with the full one: (query, genus, boot)."""
    full = bayes_best(queries, refs, k).filter("genus IS NOT NULL")
    again = resampled(queries, refs, rounds, k).withColumnRenamed("genus", "other")
    return full.join(again, "query").groupBy("query", "genus").agg(F.count_if(F.col("genus") == F.col("other")).alias("boot"))


LEVELS = ("Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species")


def assign_taxonomy(queries: DataFrame, refs: DataFrame, levels: tuple[str, ...] = LEVELS, min_boot: int = 50, try_rc: bool = False, rounds: int = 100, unite: bool | None = None) -> DataFrame:
    """Lineages of queries(seq) from references(header, seq): a column and ``<level>_boot`` for each level, one row per query.

    A reference's lineage is the whole of its ranks; a rank's bootstrap is the share (percent of ``rounds``) of draws that agree
    in it and all above. The first rank below ``min_boot`` is null, and so are those below it; unspecified ranks are null.
    Queries of under 50 letters are unassigned. With ``try_rc`` a query is turned if its other strand scores higher in its own words.
    """
    if unite is None:
        unite = is_unite(refs)
    line = S.lineage_unite(F.col("header")) if unite else S.lineage_standard(F.col("header"))
    known = refs.select(S.ranks(line, len(levels)).alias("ranks"), "seq").select(F.to_json(F.struct("ranks"), {"ignoreNullFields": "false"}).alias("genus"), "seq")
    asked = queries.select("seq").distinct()
    if try_rc:
        words = known.select(F.explode(F.array_distinct(S.kmers(F.col("seq"), 8))).alias("kmer")).distinct()
        strands = asked.select("seq", F.col("seq").alias("strand")).unionByName(asked.select("seq", S.rc(F.col("seq")).alias("strand")))
        hits = strands.select("seq", "strand", F.explode(S.kmers(F.col("strand"), 8)).alias("kmer")).join(words, "kmer").groupBy("seq", "strand").agg(F.count("*").alias("n"))
        best = strands.join(hits, ["seq", "strand"], "left").groupBy("seq").agg(F.max_by("strand", F.struct(F.coalesce("n", F.lit(0)), F.col("seq") == F.col("strand"))).alias("strand"))
        asked = best
    else:
        asked = asked.withColumn("strand", F.col("seq"))
    strand = asked.select(F.col("strand").alias("seq")).distinct()
    ranks = lambda c: F.from_json(c, "ranks array<string>")["ranks"]
    full = bayes_best(strand, known).select("query", ranks(F.col("genus")).alias("full"))
    again = resampled(strand, known, rounds).select("query", ranks(F.col("genus")).alias("other"))
    agree = [F.count_if(F.slice("full", 1, k + 1) == F.slice("other", 1, k + 1)).alias(f"b{k}") for k in range(len(levels))]
    votes = full.join(again, "query").groupBy("query").agg(*agree)
    out = asked.join(full, asked.strand == full["query"], "left").drop("query").join(votes, asked.strand == votes["query"], "left").drop("query")
    columns, open_ = [], F.lit(True)
    for k, level in enumerate(levels):
        rank, boot = F.get("full", F.lit(k)), F.round(100 * F.col(f"b{k}") / rounds, 0).cast("long")
        named = rank.isNotNull() & (rank != S.UNSPECIFIED)
        open_ = open_ & (~named | (100 * F.col(f"b{k}") >= min_boot * rounds))
        columns += [F.when(named & open_, rank).alias(level), boot.alias(f"{level}_boot")]
    return out.select("seq", *columns)


def is_unite(refs: DataFrame, look: int = 20) -> bool:
    """Do the first headers look like those of the UNITE database?"""
    first = refs.orderBy("ref_id").limit(look) if "ref_id" in refs.columns else refs.limit(look)
    return bool(first.agg(F.bool_or(F.contains("header", F.lit("FU|refs")) | F.contains("header", F.lit("FU|reps")))).first()[0])


def rank_totals(table: DataFrame, taxa: DataFrame, levels: list[str]) -> DataFrame:
    """Reads of a sequence table with a name at each rank: (stage, n)."""
    joined = table.join(taxa, "seq", "left")
    out = joined.agg(*[F.coalesce(F.sum(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("abundance"))), F.lit(0)).cast("long").alias(c) for c in levels])
    return out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in levels])).alias("x")).select("x.*")
