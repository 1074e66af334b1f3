"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments (white-space separated words, those of over
``SEGMENT`` bytes cut between characters) forwards and backwards, gives every
byte position of them a distribution over the languages, and a document's
probabilities are the mean over all these positions of its whole text. Equal segments of a slice of text are run once. Training is
backpropagation through time in numpy, on words of a bounded sample of
labelled documents (``per_language`` documents of each language, ``per_doc``
words of each), chosen by hash; all of its languages are learned.

Null text or no letter: ``und`` with score 0. Without labelled documents all
are ``und``. Ties go to the lesser name. Repeated rows get the same answer;
clashing columns give way; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, annotate, numbers, slices, text_buffers, word_hashes, words

SEGMENT = 24
HIDDEN = 16
STEPS, BATCH, STEP_SIZE = 400, 384, 0.02
PER_LANGUAGE, PER_DOC = 400, 300
SLICE = 4 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGru:
    """Two recurrent layers over bytes, one for each direction, and a softmax over their joined states."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN):
        self.languages, self.hidden = languages, hidden
        n = len(languages)
        draw = lambda seed, *shape, scale: ((numbers(int(np.prod(shape)), seed) >> np.uint64(11)).astype(np.float64) / 2**53 * 2 - 1).reshape(shape).astype(np.float32) * np.float32(scale)
        self.p = {"out": draw(9, 2 * hidden, n, scale=0.3), "bias": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": draw(ord(d), 256, 3 * hidden, scale=0.5), f"rec_{d}": draw(ord(d) + 1, hidden, 3 * hidden, scale=1 / hidden**0.5), f"add_{d}": np.zeros(hidden, np.float32)}

    def scan(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each byte of x (batch, length), in reading order of direction d."""
        h, n = self.hidden, x.shape[1]
        table, rec, add = self.p[f"in_{d}"], self.p[f"rec_{d}"], self.p[f"add_{d}"]
        state = np.zeros((len(x), h), np.float32)
        out = np.empty((n, len(x), h), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a, r = table[x[:, t]], state @ rec
            gate = _sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            z, reset = gate[:, :h], gate[:, h:]
            inner = r[:, 2 * h :] + add
            new = np.tanh(a[:, 2 * h :] + reset * inner)
            if keep is not None:
                keep.append((t, state, z, reset, inner, new))
            state = new + z * (state - new)
            out[t] = state
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position: (length, batch, languages)."""
        logits = np.concatenate([self.scan(x, "f"), self.scan(x, "b")], 2) @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss (mean over positions) and its gradient by backpropagation through time."""
        h, p = self.hidden, self.p
        tapes: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.scan(x, d, tapes[d]) for d in "fb"], 2)
        logits = states @ p["out"] + p["bias"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        prob = e / e.sum(2, keepdims=True)
        scale = np.float32(1 / (prob.shape[0] * prob.shape[1]))
        loss = float(-np.log(prob[:, np.arange(len(y)), y] + 1e-9).sum() * scale)
        prob[:, np.arange(len(y)), y] -= 1
        prob *= scale
        g = {"out": np.einsum("tbh,tbc->hc", states, prob), "bias": prob.sum((0, 1))}
        back = prob @ p["out"].T
        for k, d in enumerate("fb"):
            g_in, g_rec, g_add = np.zeros_like(p[f"in_{d}"]), np.zeros_like(p[f"rec_{d}"]), np.zeros(h, np.float32)
            carry = np.zeros((len(x), h), np.float32)
            for t, state, z, reset, inner, new in reversed(tapes[d]):
                ds = carry + back[t][:, k * h : (k + 1) * h]
                dn = ds * (1 - z) * (1 - new * new)
                dz = ds * (state - new) * z * (1 - z)
                dr = dn * inner * reset * (1 - reset)
                da = np.concatenate([dz, dr, dn], 1)
                di = np.concatenate([dz, dr, dn * reset], 1)
                one = np.zeros((256, len(x)), np.float32)
                one[x[:, t], np.arange(len(x))] = 1
                g_in += one @ da
                g_rec += state.T @ di
                g_add += (dn * reset).sum(0)
                carry = ds * z + di @ p[f"rec_{d}"].T
            g |= {f"in_{d}": g_in, f"rec_{d}": g_rec, f"add_{d}": g_add}
        return loss, g

    def train(self, by_length: dict[int, tuple[np.ndarray, np.ndarray]], steps: int = STEPS, batch: int = BATCH) -> None:
        """Adam over batches of segments of one length, lengths drawn by their numbers of bytes."""
        rng = np.random.default_rng(7)
        lengths = sorted(by_length)
        weight = np.array([len(by_length[n][1]) * n for n in lengths], float)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            x, y = by_length[lengths[rng.choice(len(lengths), p=weight / weight.sum())]]
            some = rng.integers(0, len(y), batch)
            _, g = self.gradient(x[some], y[some])
            rate = STEP_SIZE * (1 - t / (steps + 1))
            for k, a in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                a -= np.float32(rate) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + np.float32(1e-6))


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of segments, and the first of each text."""
    start, end, first = words(data, off, NOT_SPACE)
    if len(start) and (end - start).max() > SEGMENT:
        n = -(-(end - start) // SEGMENT)
        before = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(before, n)
        first = np.append(before, len(k))[first]
        start, end = np.repeat(start, n) + SEGMENT * k, np.repeat(end, n)
        for _ in range(3):  # on to the next character
            inner = np.flatnonzero((k > 0) & (start < end))
            inner = inner[(data[start[inner]] & 0xC0) == 0x80]
            start[inner] += 1
        follows = np.append(k[1:] > 0, False)
        end = np.where(follows, np.append(start[1:], 0), end)
        some = start < end
        first = np.concatenate([[0], np.cumsum(some)])[first]
        start, end = start[some], end[some]
    return start, end, first


def pooled(data: np.ndarray, off: np.ndarray, net: BiGru) -> np.ndarray:
    """Mean probabilities over all positions of each text (0 without any)."""
    import pandas as pd

    start, end, first = segments(data, off)
    n = len(net.languages)
    total = np.zeros((len(off) - 1, n))
    if not len(start):
        return total
    size = end - start
    code, distinct = pd.factorize(word_hashes(data, start, end))
    some = np.zeros(len(distinct), np.int64)
    some[code[::-1]] = np.arange(len(code))[::-1]
    sums = np.zeros((len(distinct), n))
    length = size[some]
    for k in np.unique(length).tolist():
        group = np.flatnonzero(length == k)
        for lo in range(0, len(group), 8192):
            g = group[lo : lo + 8192]
            sums[g] = net.positions(data[start[some[g]][:, None] + np.arange(k)]).sum(0)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for c in range(n):
        total[:, c] = np.bincount(doc, sums[code, c], len(off) - 1)
    return total / np.maximum(np.bincount(doc, size, len(off) - 1), 1)[:, None]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, per_doc: int = PER_DOC) -> BiGru | None:
    """A network trained on ``labelled(key, text, lang)``; None without labels."""
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int((1 << 20) * min(1.0, per_language / r.n)) + 1)])
    hashed = lambda i, w: F.struct(F.xxhash64(F.lit(5), i, w).alias("h"), w.alias("w"))
    some = labelled.filter(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 20)) < rate[F.col("lang")])
    picked = F.slice(F.array_sort(F.transform(F.split("text", r"[ \t-\r]+"), lambda w, i: hashed(i, w))), 1, per_doc)
    rows = some.select("key", "lang", F.transform(picked, lambda s: s["w"]).alias("w")).orderBy(F.xxhash64(F.lit(3), "key"), "key", "lang", "w").limit(2 * per_language * len(counts)).collect()
    names = sorted(r.lang for r in counts)
    index = {name: k for k, name in enumerate(names)}
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (str(r.key), r.lang, r.w)):
        raw = [w.encode() for w in r.w]
        start, end, _ = segments(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        flat = b"".join(raw)
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            found.setdefault(b - a, []).append((flat[a:b], index[r.lang]))
    by_length = {}
    for n, items in found.items():
        y = np.array([k for _, k in items])
        by_length[n] = np.frombuffer(b"".join(x for x, _ in items), np.uint8).reshape(-1, n), y
    net = BiGru(names)
    if by_length:
        net.train(by_length)
    return net


def identify(docs: DataFrame, net: BiGru | None, text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        best, score = np.zeros(n, np.int64), np.zeros(n)
        if net is not None:
            data, off = text_buffers(batch.column(text_col))
            for lo, hi in slices(off, SLICE):
                mean = pooled(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], net)
                best[lo:hi], score[lo:hi] = mean.argmax(1), mean.max(1)
        letters = batch.column("_letters").to_pylist()
        names = net.languages if net is not None else ["und"]
        return {"lang_pred": pa.array([names[b] if ok else "und" for b, ok in zip(best.tolist(), letters, strict=True)], pa.string()), "score": pa.array([min(1.0, s) if ok else 0.0 for s, ok in zip(score.tolist(), letters, strict=True)], pa.float64())}

    seen = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) if net is not None else F.lit(False)
    return annotate(docs.withColumn("_letters", seen), fields, run, None if only is None else [*only]).drop("_letters")


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that aren't held out."""
    net = fit(docs.filter(~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    return identify(docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("held_out")), net, text_col, [id_col, "held_out"])
