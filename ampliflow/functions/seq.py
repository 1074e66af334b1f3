"""Column builders for sequences and qualities: built-in expressions only."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the start of the PhiX174 genome (GenBank NC_001422.1) that the default screen uses.
PHIX = (
    "GAGTTTTATCGCTTCCATGACGCAGAAGTTAACACTTTCGGATATTTCTGATGAGTCGAAAAATTATCTT"
    "GATAAAGCAGGAATTACTACTGCTTGTTTACGA"
)
#: 10^(-q/10) for q = 0..93, so that sums do not depend on a pow() implementation.
ERROR_OF = [10 ** (-q / 10) for q in range(94)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def rc(seq: Column) -> Column:
    """Reverse complement; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def quals(qual: Column) -> Column:
    """Phred scores of a Phred+33 string (empty: no scores)."""
    return F.when(F.length(qual) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33))


def expected_errors(qual: Column) -> Column:
    table = F.array(*map(F.lit, ERROR_OF))
    return F.aggregate(quals(qual), F.lit(0.0), lambda s, q: s + F.get(table, q))


def count_non_acgt(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[ACGTacgt]", ""))


def _substrings(seq: Column, k: int) -> Column:
    none = F.array().cast("array<string>")
    return let(seq, lambda s: F.when(F.length(s) < k, none).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, F.lit(k)))))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order, those with other letters than A, C, G, T left out."""
    every = _substrings(seq, k)
    return F.when(seq.rlike("[^ACGT]"), F.filter(every, lambda x: ~x.rlike("[^ACGT]"))).otherwise(every)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def words_of(seq: str, k: int) -> list[str]:
    flip = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return sorted({s[i : i + k] for s in (seq, flip) for i in range(len(s) - k + 1)})


def phix_hits(seq: Column, k: int = 16, reference: str = PHIX) -> Column:
    """Positions whose k-mer occurs in the reference or its reverse complement."""
    known = F.array(*map(F.lit, words_of(reference, k)))
    count = lambda found: F.size(F.filter(found, lambda x: F.array_contains(known, x)))
    # the overlap test hashes, and few reads pass it
    return let(_substrings(seq, k), lambda found: F.when(F.arrays_overlap(found, known), count(found)).otherwise(0))


def effective_kmers(seq: Column, k: int = 2) -> Column:
    """exp(Shannon entropy) of the k-mer counts; 0 without k-mers."""


    def number(found: Column) -> Column:
        n = F.size(found)
        share = F.transform(F.array_distinct(found), lambda x: F.size(F.filter(found, lambda y: y == x)) / n)
        return F.when(n == 0, F.lit(0.0)).otherwise(F.exp(-F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.ln(p))))

    return let(kmers(seq, k), number)


def complexity(seq: Column, k: int = 2, window: int | None = None, step: int = 5) -> Column:
    """Effective k-mer number, or its least over windows; shorter sequences count whole."""
    if window is None:
        return effective_kmers(seq, k)
    if k >= window:
        raise ValueError("k must be less than the window")
    starts = F.sequence(F.lit(0), F.length(seq) - window, F.lit(step))
    slid = F.array_min(F.transform(starts, lambda s: effective_kmers(F.substr(seq, s + 1, F.lit(window)), k)))
    return F.when(F.length(seq) < window, effective_kmers(seq, k)).otherwise(slid)


def inflate(rate: Column, by: float) -> Column:
    return F.least(F.greatest(rate * by / (1 + (by - 1) * rate), F.lit(0.0)), F.lit(1.0))


def nominal(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def lineage_standard(header: Column) -> Column:
    """The lineage of a header: all of it if a ';' comes before the first blank, else what follows the first blank."""
    blank, semi = F.instr(header, " "), F.instr(header, ";")
    return F.when((semi > 0) & ((blank == 0) | (semi < blank)), header).when(blank > 0, F.trim(F.substr(header, blank + 1))).otherwise("")


UNSPECIFIED = "_UNSPECIFIED"


def lineage_unite(header: Column, sentinel: str = UNSPECIFIED) -> Column:
    """The lineage of a UNITE header: its fifth field without rank prefixes, unidentified ranks as a sentinel."""
    field = F.split_part(header, F.lit("|"), F.lit(5))
    return F.regexp_replace(F.regexp_replace(field, "[kpcofgs]__unidentified", sentinel), "[kpcofgs]__", "")


def ranks(lineage: Column, n: int) -> Column:
    """The first n ranks of a lineage, missing ones null."""
    some = F.filter(F.transform(F.split(lineage, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.concat(some, F.array_repeat(F.lit(None).cast("string"), n)), 1, n)


def genus_matches(tax: Column, binomial: Column, glyph: str = "/") -> Column:
    """Is an assigned genus (which may be split, or carry more words) that of a binomial? False for nulls and blanks."""
    tax, binomial = F.trim(tax), F.trim(binomial)
    same = (tax == binomial) | F.endswith(tax, F.concat(F.lit(glyph), binomial))
    for sep in (" ", "_", glyph):
        same |= F.startswith(tax, F.concat(binomial, F.lit(sep)))
    return F.coalesce(same & (tax != "") & (binomial != ""), F.lit(False))


def genus_species(header: Column) -> tuple[Column, Column]:
    """The second and third words of a header, blank where missing."""
    words = F.split(F.trim(header), r"\s+")
    return F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.coalesce(F.get(words, F.lit(2)), F.lit(""))


def codes(seq: Column) -> Column:
    """A, C, G, T, N as 1 to 5 and a gap as 9; anything else is 0."""
    return F.translate(F.regexp_replace(seq, "[^ACGTN-]", "?"), "ACGTN-?", "1234590")


def ordered_distance(a: Column, b: Column, k: int = 5) -> Column:
    """1 - the share of positions at which both have the same k-mer."""
    n = F.least(F.length(a), F.length(b)) - k + 1
    equal = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(k)) == F.substr(b, i, F.lit(k)))
    return F.when(n > 0, 1 - F.size(equal) / n)


def gapless(a: Column, b: Column) -> tuple[Column, Column]:
    """Letter against letter, the shorter one filled up with gaps."""
    n = F.greatest(F.length(a), F.length(b))
    return F.rpad(a, n, F.lit("-")), F.rpad(b, n, F.lit("-"))


def substitutions(x: Column, y: Column) -> Column:
    """(pos, from_nt, to_nt) where letters of an alignment differ, by the place in the first from 0; N and gaps are none."""
    at = lambda s, i: F.substr(s, i, F.lit(1))
    differ = lambda i: (at(x, i) != at(y, i)) & ~at(x, i).isin("-", "N") & ~at(y, i).isin("-", "N")
    place = lambda i: F.length(F.replace(F.substr(x, F.lit(1), i), F.lit("-"), F.lit(""))) - 1
    every = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), differ)
    return F.transform(every, lambda i: F.struct(place(i).cast("long").alias("pos"), at(x, i).alias("from_nt"), at(y, i).alias("to_nt")))


def fold_escherichia(genus: Column) -> Column:
    return F.when(genus.contains("Escherichia") | genus.contains("Shigella"), "Escherichia/Shigella").otherwise(genus)


def count_text(n: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


