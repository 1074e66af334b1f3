"""Personal data in texts, with DataFrame functions only.

Base spans come from four fixed patterns (email, ip, card, phone), leftmost and
not overlapping within a kind; matches that fail a kind's test are dropped.
Further spans come from weak supervision: candidates are found by shape;
regex, gazetteer and context labelers vote (1, 0 or -1) on each; expectation-
maximisation over the counts of vote patterns (at most 3^6) estimates their
reliabilities. A logistic span classifier is trained on the resulting
probabilities, from features of the span alone (length, shares of letter kinds,
variety, kind, the hashed word before it), as votes would explain them wholly;
its log odds beyond the prior are added to those of the votes and decide. It is
fitted to at most ``SAMPLE`` distinct candidates, those of least hash, weighted
by how often they occur. Added spans that touch a base span are dropped.

Positions are code points, ends exclusive. Null text is empty: no spans; an
empty table gives no rows. Repeated rows are treated alike; input columns named
as a result column give way, all others stay. The patterns
are written so that runs of any length take linear time and constant stack: a
match may begin only where a run begins or where the last match ended, and
runs are possessive; both leave the matches unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "ssn", "iban"]
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": None, "card": None, "phone": "+"}  # a character without which there is no match; None: a digit
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:"
    r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}"
    r"|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"
    r"|(?<!_)(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+"
    r")"
)
#: Gazetteers: cues before a candidate, cues against it, and ends of addresses.
CUES = "password|passwd|pwd|token|secret|key|api|auth|ssn|social|iban|account|konto|compte|cuenta|tel|phone|call|fax|mobile|mail|contact"
AGAINST = r"(?:version|isbn|doi|sha|commit|figure|table|page|v\.?|no\.?|#|/)\s*$"
ENDINGS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu"
BEFORE = 24  # characters of context
ROUNDS = 30
SAMPLE, WORDS, FEATURES = 20_000, 32, 11  # candidates to learn from, buckets of words before a candidate, its other features
BLOCK = 256


def running(items: Column, item_type: str, emit: Callable[[Column, Column], Column], to: Callable[[Column, Column], Column]) -> tuple[Column, Column]:
    """Fold ``items`` with a position: emit(position, item) is appended (unless null), to(position, item) is the next position.

    Returns the appended values and the last position. Values are gathered in
    blocks, so that the steps do not copy all that came before.
    """
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<array<{item_type}>>").alias("done"), F.array().cast(f"array<{item_type}>").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["now"]) >= BLOCK
        new = F.filter(F.array(emit(acc["pos"], x)), lambda v: v.isNotNull())
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(to(acc["pos"], x).alias("pos"), done.alias("done"), F.when(full, new).otherwise(F.concat(acc["now"], new)).alias("now"))

    made = F.aggregate(items, start, step, lambda acc: F.struct(F.flatten(F.concat(acc["done"], F.array(acc["now"]))).alias("values"), acc["pos"].alias("pos")))
    return made["values"], made["pos"]


def located(hits: Column, pieces: Column) -> Column:
    """array<struct(start, end, hit, before)> from all matches and the pieces of text between them."""
    both = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).cast("long").alias("gap"), F.length(h).cast("long").alias("size"), h.alias("hit"), F.right(p, F.lit(BEFORE)).alias("before")))
    emit = lambda pos, x: F.struct((pos + x["gap"]).alias("start"), (pos + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))
    return running(both, "struct<start:bigint,end:bigint,hit:string,before:string>", emit, lambda pos, x: pos + x["gap"] + x["size"])[0]


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(hit, "[^0-9]", ""), ""))
    return F.aggregate(F.transform(digits, lambda d, k: F.when(k % 2 == 1, (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10)).otherwise(d.cast("int")).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if kind == "ip":
        return hit.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?(?:\.|$)){4}$") & ~hit.rlike(r"\.$")
    if kind == "card":
        return F.when(digits.between(14, 19), _luhn(hit)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["hit"])


def _votes(kind: Column, hit: Column, pre: Column) -> Column:
    """Votes of the six labelers: shape, gazetteer, punctuation before, variety, context against, digits."""
    secret, phone, email = kind == "secret", kind == "phone", kind == "email"
    digits, size = F.length(F.regexp_replace(hit, "[^0-9]", "")), F.length(hit)
    variety = F.size(F.array_distinct(F.split(hit, "")))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return F.array(
        vote(hit.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|\(?[0-9]{3}\) .*|[0-9]{3}-[0-9]{2}-[0-9]{4})$") | (kind == "iban") | hit.rlike(r"[\[(] ?(?:at|dot)"), secret & hit.rlike("^[A-Za-z]+[0-9]{1,2}$")),
        vote(F.lower(pre).rlike(rf"(?:{CUES})\W{{0,4}}(?:is\W)?$"), F.lit(False)),
        vote(pre.rlike("[=:\"'(]\\s*$"), F.lit(False)),
        vote(variety >= 8, variety <= 4),
        vote(F.lit(False), F.lower(pre).rlike(AGAINST)),
        vote(F.when(secret, digits.between(size * 0.1, size * 0.9)).when(email, hit.rlike(rf"(?:{ENDINGS})$")).when(phone, ~hit.rlike(r"^\(?[01]")).otherwise(True), F.lit(True)),
    )


def _kind(hit: Column) -> Column:
    return (
        F.when(hit.rlike(r"[\s\])]at[\s\])]"), "email")
        .when(hit.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone")
        .when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(hit.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}$") & ~hit.rlike("^AKIA"), "iban")
        .otherwise("secret")
    )


def _features(kind: Column, hit: Column, pre: Column) -> Column:
    """Length, shares of digits, capitals, small letters and the rest, variety, and the kind (one of five)."""
    size = F.length(hit)
    share = lambda letters: F.length(F.regexp_replace(hit, f"[^{letters}]", "")) / size
    own = [F.least(size / 32, F.lit(4.0)), share("0-9"), share("A-Z"), share("a-z"), 1 - share("0-9A-Za-z"), F.size(F.array_distinct(F.split(hit, ""))) / size]
    return F.array(*[x.cast("double") for x in own], *[F.when(kind == k, 1.0).otherwise(0.0) for k in ("email", "phone", "secret", "ssn", "iban")])


def _candidates(docs: DataFrame, text: str, t: Callable[[str], str]) -> DataFrame:
    """``docs`` with cand: array<struct(start, end, kind, votes, features, word)>; ``t`` names own columns."""
    maybe = F.col(text).rlike("[0-9]") | (F.contains(text, F.lit("at")) & F.contains(text, F.lit("dot")))
    none = F.array().cast("array<string>")
    docs = docs.withColumn(t("hits"), F.when(maybe, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    docs = docs.withColumn(t("pieces"), F.when(F.size(t("hits")) > 0, F.split(text, CANDIDATE, -1)).otherwise(none))

    def seen(s: Column) -> Column:
        kind = _kind(s["hit"])
        word = F.pmod(F.crc32(F.lower(F.regexp_extract(s["before"], "([A-Za-z]+)[^A-Za-z]*$", 1))), F.lit(WORDS)).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), _votes(kind, s["hit"], s["before"]).alias("votes"), _features(kind, s["hit"], s["before"]).alias("features"), word.alias("word"))

    return docs.withColumn(t("cand"), F.transform(located(F.col(t("hits")), F.col(t("pieces"))), seen)).drop(t("hits"), t("pieces"))


def estimate(patterns: list[tuple[list[int], int]], rounds: int = ROUNDS) -> tuple[list[float], list[tuple[float, float]], float]:
    """Expectation-maximisation over (votes, count): probabilities of the patterns, for each labeler its rates of a 1 given true, given false (among votes cast), and the prior."""
    n = len(patterns[0][0]) if patterns else 0
    rates, prior, post = [(0.8, 0.3)] * n, 0.5, []
    for _ in range(rounds):
        post = []
        for votes, _count in patterns:
            odds = math.log(prior / (1 - prior))
            for v, (a, b) in zip(votes, rates, strict=True):
                odds += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b)) if v < 0 else 0.0
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        new = []
        for j in range(n):
            cast = [(p, c, votes[j] > 0) for p, (votes, c) in zip(post, patterns, strict=True) if votes[j]]
            true, false = sum(p * c for p, c, _ in cast), sum((1 - p) * c for p, c, _ in cast)
            new.append(((sum(p * c for p, c, y in cast if y) + 8) / (true + 10), (sum((1 - p) * c for p, c, y in cast if y) + 3) / (false + 10)))
        rates = new
        weight = sum(c for _, c in patterns)
        prior = min(0.95, max(0.05, sum(p * c for p, (_, c) in zip(post, patterns, strict=True)) / max(weight, 1)))
    return post, rates, prior


def train(features: np.ndarray, word: np.ndarray, times: np.ndarray, post: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights (bias, features, words) of a logistic classifier fitted to probabilities by Newton's method with a ridge."""
    x = np.concatenate([np.ones((len(features), 1)), features, np.eye(WORDS)[word]], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - post)) + w
        bend = (x * (times * (p * (1 - p) + 1e-3))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(bend, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def odds(rates: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What a vote of 1 and one of -1 of each labeler add to the log odds."""
    return [(math.log(a / b), math.log((1 - a) / (1 - b))) for a, b in rates]


def _learned(docs: DataFrame, text: Column) -> tuple[list[tuple[float, float]], list[float]]:
    """The log odds of the votes and the weights of the features, from the candidates of all documents."""
    found = _candidates(docs.select(text.alias("text")), "text", lambda n: f"own_{n}").select(F.explode("own_cand").alias("c")).select("c.votes", "c.features", "c.word")
    found = Scratch(docs.sparkSession).save(found.groupBy("votes", "features", "word").agg(F.count("*").alias("n")), "candidates")
    patterns = [(list(r.votes), r.n) for r in found.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()]
    probable, rates, _ = estimate(patterns)
    post = {tuple(v): p for (v, _), p in zip(patterns, probable, strict=True)}
    some = found.orderBy(F.xxhash64("votes", "features", "word"), "votes", "features", "word").limit(SAMPLE).collect()
    features = np.array([r.features for r in some], float).reshape(len(some), FEATURES)
    weights = train(features, np.array([r.word for r in some], int), np.array([r.n for r in some], float), np.array([post[tuple(r.votes)] for r in some], float))
    return odds(rates) or [(0.0, 0.0)] * 6, weights.tolist()


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and span_list: array<struct(start, kind, end)>, kind an index of ``KINDS``."""
    new = {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "span_list"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    t = lambda name: own + name
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by_votes, weights = _learned(docs, text)

    none = F.array().cast("array<string>")
    docs = docs.withColumn(t("text"), text)
    for kind in BASE:
        seen = F.contains(F.col(t("text")), F.lit(HINT[kind])) if HINT[kind] else F.col(t("text")).rlike("[0-9]")
        docs = docs.withColumn(t(f"h_{kind}"), F.when(seen, F.regexp_extract_all(t("text"), F.lit(PATTERN[kind]), F.lit(0))).otherwise(none))
    for kind in BASE:
        docs = docs.withColumn(t(f"p_{kind}"), F.when(F.size(t(f"h_{kind}")) > 0, F.split(t("text"), PATTERN[kind], -1)).otherwise(none))
    docs = docs.withColumns({t(f"s_{k}"): F.filter(located(F.col(t(f"h_{k}")), F.col(t(f"p_{k}"))), _passes(k)) for k in BASE})
    docs = _candidates(docs.drop(*[t(f"{x}_{k}") for x in "hp" for k in BASE]), t("text"), t)
    spans_of = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(t(f"s_{k}"), spans_of(i)) for i, k in enumerate(BASE)]))
    docs = docs.withColumns({f"n_{k}": F.size(t(f"s_{k}")).cast("long") for k in BASE} | {t("base"): base})
    of_features, of_words = weights[1:-WORDS], weights[-WORDS:]
    said_by = lambda c: sum((F.when(F.get(c, F.lit(j)) > 0, yes).when(F.get(c, F.lit(j)) < 0, no).otherwise(0.0) for j, (yes, no) in enumerate(by_votes)), F.lit(0.0))
    dot = lambda c, w: F.aggregate(F.zip_with(c, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    # the prior's log odds are in both parts and are taken off once
    logit = lambda c: F.lit(weights[0]) + said_by(c["votes"]) + dot(c["features"], of_features) + F.get(F.array(*map(F.lit, of_words)), c["word"])
    free = lambda c: ~F.exists(t("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    index = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    added = F.transform(F.filter(t("cand"), lambda c: (logit(c) >= 0) & free(c)), lambda c: F.struct(c["start"].alias("start"), index[c["kind"]].alias("kind"), c["end"].alias("end")))
    docs = docs.withColumn("span_list", F.array_sort(F.concat(t("base"), added)))
    names = F.array(*map(F.lit, KINDS))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    docs = docs.withColumns({"base_sha256": F.sha2(said(t("base")), 256), "spans": said("span_list")})
    return docs.drop(t("text"), t("base"), t("cand"), *[t(f"s_{k}") for k in BASE])


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``find_pii``'s rows with each span (overlapping ones merged) replaced by ``<KIND>``."""
    text, names = F.col(text_col), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    cut = lambda pos, s: F.when(s["start"] >= pos, F.concat(F.substr(text, (pos + 1).cast("int"), (s["start"] - pos).cast("int")), F.get(names, s["kind"])))
    pieces, end = running(F.col("span_list"), "string", cut, lambda pos, s: F.greatest(pos, s["end"]))
    out = found.withColumn("_cut", F.struct(pieces.alias("pieces"), end.alias("end")))
    clean = F.concat(F.array_join("_cut.pieces", ""), F.substr(text, (F.col("_cut.end") + 1).cast("int")))
    return out.withColumn(text_col, F.when(F.size("span_list") > 0, clean).otherwise(text)).drop("_cut")
