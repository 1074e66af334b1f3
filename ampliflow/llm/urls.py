"""URL filter: rules first, then gradient-boosted trees on lexical features.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
path: from there up to ``? #`` or the end; null or no ``://``: both empty. A
rule ``host/path`` fits its host and all subdomains if the path starts with
the rule's; the longest wins. The URLs that a rule decides are the labelled
URLs; trees learn from at most ``sample`` distinct ones of them (those of least
hash), with suffix statistics over all, and judge the rest. Features: lengths,
depth, digit ratio, entropy, parameter counts and block rates of suffixes,
which a learning URL takes from the half of the URLs it isn't in. Without
labelled URLs of both verdicts, the rest gets the only verdict seen (else
``allow``). Results depend neither on the order nor on the partitions of rows.
Repeated rows are judged alike; clashing input columns give way; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, annotate, byte_table, mix, slices, text_buffers

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SAMPLE = 20_000
SUFFIX_SLOTS = 1024
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.2


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _suffixes(host: str) -> tuple[int, int]:
    """Slots of the last label and of the last two labels."""
    labels = host.split(".")
    return tuple(int(mix(np.frombuffer(s.encode().ljust(-(-len(s.encode()) // 8) * 8 or 8, b"\0"), "<u8").sum(keepdims=True, dtype=np.uint64))[0] % SUFFIX_SLOTS) for s in (labels[-1], ".".join(labels[-2:])))


_CLASS = {"digit": byte_table(lambda b: 48 <= b <= 57), "slash": byte_table(lambda b: b == 47), "dot": byte_table(lambda b: b == 46), "dash": byte_table(lambda b: b in b"-_"), "param": byte_table(lambda b: b in b"?&"), "equal": byte_table(lambda b: b == 61), "percent": byte_table(lambda b: b == 37)}


def features(urls: pa.Array, hosts: pa.Array, rates: np.ndarray) -> np.ndarray:
    """Rows of: length, host length, depth, labels, digit ratio, entropy, parameters, assigned, dashes, escapes, two suffix rates."""
    data, off = text_buffers(urls)
    data = LOWER[data]
    size = np.diff(off)
    out = np.zeros((len(size), 12))
    for lo, hi in slices(off):
        part, n = data[off[lo] : off[hi]], size[lo:hi]
        row = np.repeat(np.arange(hi - lo), n)
        count = lambda k: np.bincount(row, _CLASS[k][part], hi - lo)  # noqa: B023, E731
        pair, times = np.unique(row * 256 + part, return_counts=True)
        share = times / n[pair >> 8]
        x = out[lo:hi]
        x[:, 0], x[:, 2], x[:, 4] = n, count("slash"), count("digit") / np.maximum(n, 1)
        x[:, 5] = np.bincount(pair >> 8, -share * np.log2(share), hi - lo)
        x[:, 6], x[:, 7], x[:, 8], x[:, 9] = count("param"), count("equal"), count("dash"), count("percent")
    names = [h or "" for h in hosts.to_pylist()]
    out[:, 1] = [len(h) for h in names]
    out[:, 3] = [h.count(".") for h in names]
    known: dict[str, tuple[int, int]] = {}
    for i, h in enumerate(names):
        tail = h[-64:]
        if tail not in known:
            known[tail] = _suffixes(tail)
        out[i, 10:] = rates[0, known[tail][0]], rates[1, known[tail][1]]
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> tuple[float, list]:
    """Log-loss boosting of histogram trees: a base score and (feature, threshold, leaf) arrays of complete trees."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    score, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best, choice = np.full(n, 1e-9), [None] * n
            for f, e in enumerate(edges):
                slot = (node - first) * (bins + 1) + code[:, f]
                gs, hs = (np.bincount(slot, v, n * (bins + 1)).reshape(n, -1).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                for k in range(n):
                    b = int(np.argmax(gain[k, : len(e)])) if len(e) else 0
                    if len(e) and gain[k, b] > best[k] + 1e-9:
                        best[k], choice[k] = gain[k, b], (f, e[b])
            for k, c in enumerate(choice):
                if c:
                    feature[first + k], threshold[first + k] = c
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + 1)
        score += leaf[leaf_of]
        made.append((feature, threshold, leaf))
    return base, made


def boosted(x: np.ndarray, model: tuple[float, list]) -> np.ndarray:
    """Probability of a block."""
    base, trees = model
    score, rows = np.full(len(x), base), np.arange(len(x))
    for feature, threshold, leaf in trees:
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < len(feature):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        score += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-score))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score (null where a rule decides)."""
    rules = RULES if rules is None else rules
    new = {"host", "path", "rule", "verdict", "block_score"}
    url = F.col(url_col)
    host, path = host_and_path(url)
    split = pages.select(*[c for c in pages.columns if c.lower() not in new], F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    split = split.withColumn("_by", ruled(F.col("host"), F.col("path"), rules).cast("struct<verdict:string,rule:string>"))
    told = split.filter("_by IS NOT NULL").select(url.alias("url"), "host", F.col("_by.verdict").alias("verdict"))
    totals = {r.verdict: r.n for r in told.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        model, rates = (-9.0 if "block" not in totals else 9.0, []), np.zeros((2, SUFFIX_SLOTS))
    else:

        def slots(batch: pa.RecordBatch) -> dict:
            both = [_suffixes((h or "")[-64:]) for h in batch.column("host").to_pylist()]
            return {"slot": pa.array([[a, SUFFIX_SLOTS + b] for a, b in both], pa.list_(pa.int32()))}

        half = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
        spread = annotate(told.withColumn("half", half), [T.StructField("slot", T.ArrayType(T.IntegerType()))], slots, only=["verdict", "half"])
        counts = spread.select("verdict", "half", F.explode("slot").alias("slot")).groupBy("slot", "half").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("b")).collect()
        prior = totals["block"] / sum(totals.values())
        n, blocked = np.zeros((2, 2 * SUFFIX_SLOTS)), np.zeros((2, 2 * SUFFIX_SLOTS))
        for r in counts:
            n[r.half, r.slot], blocked[r.half, r.slot] = r.n, r.b
        rate = lambda b, n: ((b + 4 * prior) / (n + 4)).reshape(2, -1)
        rates = rate(blocked.sum(0), n.sum(0))
        distinct = told.agg(F.approx_count_distinct("url")).first()[0]
        share = min(1.0, 2 * sample / max(distinct, 1))
        hashed = F.xxhash64(F.lit(9), "url")
        some = told.filter(F.pmod(hashed, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).withColumn("half", half).distinct().orderBy(hashed, "url").limit(sample).toArrow()
        x = np.zeros((len(some), 12))
        own = some["half"].to_numpy()
        for k in (0, 1):
            rows = np.flatnonzero(own == k)
            part = some.take(pa.array(rows))
            x[rows] = features(part["url"].combine_chunks(), part["host"].combine_chunks(), rate(blocked[1 - k], n[1 - k]))
        model = grow(x, (np.array(some["verdict"].to_pylist()) == "block").astype(float))

    def run(batch: pa.RecordBatch) -> dict:
        return {"block_score": pa.array(boosted(features(batch.column(url_col), batch.column("host"), rates), model), pa.float64())}

    scored = annotate(split, [T.StructField("block_score", T.DoubleType())], run)
    by = F.col("_by")
    return scored.withColumns({"rule": by["rule"], "verdict": F.coalesce(by["verdict"], F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")), "block_score": F.when(by.isNull(), F.col("block_score"))}).drop("_by")
