"""Scores of texts under a hashed maximum-entropy language model.

Tokens are lower-cased (A-Z) white-space words and one end token a text. Every
token is in a class: the most frequent words make classes of equal size, all
other words of the shared counts are in the class of their topic, and the rest
(rare and new words, and those seen once, which tell how likely new ones are)
in one of its own. Topics are found by spherical k-means over all training
texts, of any length, from their counts of the ``TOPIC_WORDS`` most frequent
tokens; it begins with the words that best span the main directions of the texts.
Each training text counts for the topic its words speak for most, and a word is
of the topic it is counted most often in, over all training tokens.
Classes of frequent words are filled topic by topic. What is summed over texts
are whole numbers, so topics do not depend on partitions.

The probability of a token is that of its class given the history times that
of the word in the class: two softmaxes over hashed features of the history
(bias, bigram, trigram, a skip, the classes of the last three tokens). A word
of a class that is not of frequent words has its share of the smoothed counts
there. The model begins with the shares of classes and words, and is trained
once over all training texts: in each of ``ROUNDS`` rounds every task makes
gradient updates on its part from the current weights, and the changes are
averaged for each feature over the tasks that saw it. Small partitions are
read together, since the changes of a task are of one size however few its texts.

Counts cover all training tokens (keys are 64-bit hashes of words). Counts of
at most ``SHARED`` frequent tokens are broadcast; those of all others are
joined. Null text is empty: the end token alone. Repeated rows are scored
each. An empty training set leaves N = V = 0, and uniform class weights; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, LOWER, NOT_SPACE, Scratch, mix, numbers, slices, text_buffers, words

CLASSES, PER_CLASS = 32, 32
TOPICS = 8
OPEN = CLASSES + TOPICS + 1  # all classes; the last one is of rare and new words
TOPIC_WORDS = 2048  # words that tell topics apart
TURNS, PASSES = 3, 10  # passes over the texts: of the power iteration for the directions, of k-means at most
ENTRIES = 1 << 18  # words of texts handled at a time
UNIT = float(1 << 24)  # what is summed over texts is rounded to whole numbers of 1 / UNIT
SLOTS = 1 << 15
BLOCKS = 64  # parts into which the weights are split when they are averaged
ROUNDS = 2
SHARED = 1 << 20
RATE, BATCH = 4.0, 4096
NEAR = 8  # rows of a slot that are added one by one, before the rest is added at once
END = np.uint64(0x5851F42D4C957F2D)
SLICE = 4 << 20
TASK_TOKENS = 1 << 21  # a task has so many tokens at least, on average, unless there are fewer tasks than cores
SPAN = 1 << 15  # bytes hashed at a time
STEP = 0xD1342543DE82EF95
VALUE = np.where(NOT_SPACE, _BYTE[LOWER], np.uint64(0))  # of each byte in lower case
POWER = np.cumprod(np.full(2 * SPAN, STEP, np.uint64))
INVERSE = np.cumprod(np.append(np.uint64(1), np.full(SPAN - 1, pow(STEP, -1, 2**64), np.uint64)))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased words with nothing but white space between them; a word of any length has the same hash wherever it is.

    Those of ``word_hashes`` where no word is longer than 4,096 bytes: powers count from the first word of a span, then each word is brought back to its own start.
    """
    out = np.empty(len(start), np.uint64)
    cut = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), SPAN)), len(start)))
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        lo, hi = start[i], end[j - 1]
        value = VALUE.take(data[lo:hi])
        value *= POWER[: hi - lo] if hi - lo <= len(POWER) else np.cumprod(np.full(hi - lo, STEP, np.uint64))
        at = start[i:j] - lo
        out[i:j] = np.add.reduceat(value, at) * INVERSE[at]
    return mix(out + (end - start).astype(np.uint64))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, end tokens included, and where each text's begin (and their number)."""
    start, end, first = words(data, off, NOT_SPACE)
    begin = first + np.arange(len(off))
    out = np.empty(len(start) + len(off) - 1, np.uint64)
    out[begin[1:] - 1] = END
    word = np.ones(len(out), bool)
    word[begin[1:] - 1] = False
    out[word] = hashes(data, start, end)
    return out, begin


def history(token: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the features at each token: (features, tokens). ``kind``: the classes of the tokens."""
    place = np.arange(len(token)) - np.repeat(begin[:-1], np.diff(begin))
    before, classes = [], np.zeros(len(token), np.uint64)
    for k in (1, 2, 3):
        p, c = np.zeros(len(token), np.uint64), np.zeros(len(token), np.uint64)
        p[k:] = token[:-k] if len(token) > k else token[:0]
        c[k:] = kind[:-k] + 1 if len(token) > k else c[:0]
        p[place < k], c[place < k] = k, 0
        before.append(p)
        classes = classes * np.uint64(64) + c
    a, b, _ = before
    one = np.uint64(0x9E3779B97F4A7C15)
    return np.stack([np.full(len(token), one), mix(a + one), mix(mix(a) + b), mix(b ^ one), mix(classes * one)])


def unit(word: np.ndarray, times: np.ndarray, begin: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the words of texts, each text a vector of length one (or zero). ``begin``: where each text's begin (and their number)."""
    x = np.log1p(times) * idf[word]
    size = np.sqrt(np.add.reduceat(x * x, begin[:-1]))
    return x / np.repeat(np.maximum(size, 1e-9), np.diff(begin))


def project(x: np.ndarray, word: np.ndarray, begin: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Products of texts with the columns of ``onto`` (words, columns): (texts, columns)."""
    return np.add.reduceat(x.astype(np.float32)[:, None] * onto.astype(np.float32)[word], begin[:-1])


def first_centres(onto: np.ndarray) -> np.ndarray:
    """First centres of topics (words, TOPICS) from main directions (words, directions): words that span these best, by QR with pivots, each as projected on them."""
    left, out = onto.copy(), np.zeros((len(onto), TOPICS))
    for t in range(onto.shape[1]):
        size = (left * left).sum(1)
        at = size.argmax()
        if size[at] < 1e-12:
            break
        out[:, t] = onto @ onto[at] / np.sqrt((onto[at] ** 2).sum())
        left = left - np.outer(left @ left[at], left[at]) / size[at]
    return out


def by_topic(value: np.ndarray, word: np.ndarray, begin: np.ndarray, topic: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``value`` by topic of the text and word: (TOPICS, width)."""
    return np.bincount(np.repeat(topic, np.diff(begin)) * width + word, value, TOPICS * width).reshape(TOPICS, width)


def topic_of(one: np.ndarray, back: np.ndarray, begin: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The topic of each text (the first one for texts without known words). ``one``, ``back``: distinct tokens, and which of them each is."""
    key, odds = table
    if not len(key):
        return np.zeros(len(begin) - 1, np.int64)
    at = np.minimum(np.searchsorted(key, one), len(key) - 1)
    gain = np.where((key[at] == one)[:, None], odds[at], 0.0)
    return np.add.reduceat(gain[back], begin[:-1]).argmax(1)


class Words:
    """The shared tokens: hash, count, topic; classes of frequent ones by topic."""

    def __init__(self, key: np.ndarray, n: np.ndarray, topic: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.n, topic = key[order], n[order].astype(np.int64), topic[order].astype(np.int64)
        top = np.lexsort((self.key, -self.n))[: CLASSES * PER_CLASS]
        top = top[np.argsort(topic[top], kind="stable")]
        self.kind, self.member = np.where(self.n > 1, CLASSES + topic, OPEN - 1).astype(np.int16), np.full(len(key), -1, np.int16)
        self.kind[top], self.member[top] = np.arange(len(top)) // PER_CLASS, np.arange(len(top)) % PER_CLASS
        self.tops = len(top)
        self.key = np.append(self.key, np.uint64(2**64 - 1))
        self.n, self.kind, self.member = np.append(self.n, 0), np.append(self.kind, np.int16(OPEN - 1)), np.append(self.member, np.int16(-1))

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and member (-1: not a frequent word) of each token, and its count (0: not shared)."""
        one, back = np.unique(token, return_inverse=True)
        at = np.searchsorted(self.key, one)
        at[self.key[at] != one] = len(self.key) - 1  # the last one has no count and is in the class of new words
        at = at[back]
        return self.kind[at], self.member[at], self.n[at]


class Model:
    """Weights of both softmaxes: ``outer`` (slots, classes) and ``inner`` (slots, words of a class)."""

    def __init__(self, words: Words, outer: np.ndarray | None = None, inner: np.ndarray | None = None):
        self.words = words
        self.no_word = (np.arange(CLASSES * PER_CLASS) >= words.tops).reshape(CLASSES, PER_CLASS)
        self.no_class = np.concatenate([self.no_word.all(1), np.bincount(words.kind, minlength=OPEN)[CLASSES:] == 0])
        self.outer = np.zeros((SLOTS, OPEN), np.float32) if outer is None else outer.copy()
        self.inner = np.zeros((SLOTS, PER_CLASS), np.float32) if inner is None else inner.copy()
        self.room = [np.empty((2, BATCH, t.shape[1]), np.float32) for t in (self.outer, self.inner)]  # used again for each batch

    def begin(self, total: int) -> None:
        """The shares of classes and of their words as weights of the bias."""
        one = np.array([[0x9E3779B97F4A7C15]], np.uint64)
        w = self.words
        of = np.bincount(w.kind, w.n, OPEN)
        of[-1] += total - w.n.sum()
        self.outer[self.slots(one)[0, 0]] = np.log((of + 1) / (total + OPEN))
        for k in range(CLASSES):
            some = np.flatnonzero((w.kind == k) & (w.member >= 0))
            share = np.zeros(PER_CLASS)
            share[w.member[some]] = np.log((w.n[some] + 1) / (w.n[some].sum() + len(some)))
            self.inner[self.slots(mix(one + np.uint64(k + 1)))[0, 0]] = share

    def targets(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, member, _ = self.words.find(token)
        return kind, member

    @staticmethod
    def slots(features: np.ndarray) -> np.ndarray:
        return (features >> np.uint64(64 - 15)).astype(np.uint16)

    @staticmethod
    def softmax(table: np.ndarray, slots: np.ndarray, absent: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Probabilities of rows of feature slots (features, rows), in ``room`` till it is used again; ``absent`` columns (of all rows, or of each) have none."""
        x, part = room[:, : slots.shape[1]]
        if not len(x):  # no token of the batch is in a class
            return x
        take = lambda s, out: np.take(table, s, 0, out, "clip")  # noqa: E731 (no slot is out of range, but only "clip" writes to ``out`` at once)
        take(slots[1], x)
        x += table[slots[0, 0]] if (slots[0] == slots[0, :1]).all() else take(slots[0], part)  # the bias is one row for all
        for s in slots[2:]:
            x += take(s, part)
        if absent.any():
            x += np.where(absent, np.float32(-1e9), np.float32(0))
        if max(x.max(), -x.min()) > 60:  # else exp neither overflows nor vanishes
            x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= np.einsum("ij->i", x)[:, None]
        return x

    def forward(self, f: np.ndarray, kind: np.ndarray, member: np.ndarray) -> tuple:
        """Slots and probabilities: of the classes, and (for words of a class) of its words; and which rows these are."""
        o = self.slots(f)
        known = np.flatnonzero(member >= 0)
        k = kind[known]
        i = self.slots(mix(f[:, known] + k.astype(np.uint64) + np.uint64(1)))
        return o, self.softmax(self.outer, o, self.no_class, self.room[0]), known, i, self.softmax(self.inner, i, self.no_word[k] if self.no_word.any() else self.no_word, self.room[1])

    def log10(self, token: np.ndarray, begin: np.ndarray, target: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """For each token the log10 probability, but for the share in its class of a word that is not a frequent one. ``target``: class and member of each, where known."""
        kind, member = target or self.targets(token)
        f = history(token, kind, begin)
        out = np.empty(len(token))
        for lo in range(0, len(token), BATCH):
            part = slice(lo, lo + BATCH)
            k, m = kind[part], member[part]
            _, p, known, _, q = self.forward(f[:, part], k, m)
            logp = np.log10(p[np.arange(len(k)), k] + 1e-30)
            logp[known] += np.log10(q[np.arange(len(known)), m[known]] + 1e-30)
            out[part] = logp
        return out

    def update(self, token: np.ndarray, begin: np.ndarray, seen: tuple[np.ndarray, np.ndarray]) -> None:
        """Gradient steps over batches of tokens; steps of a slot shrink with how often it was seen."""
        kind, member = self.targets(token)
        f = history(token, kind, begin)
        for lo in range(0, len(token), BATCH):
            part = slice(lo, lo + BATCH)
            k, m = kind[part], member[part]
            o, p, known, i, q = self.forward(f[:, part], k, m)
            p[np.arange(len(k)), k] -= 1
            q[np.arange(len(known)), m[known]] -= 1
            for slot, grad, table, n in ((o, p, self.outer, seen[0]), (i, q, self.inner, seen[1])):
                if not len(grad):
                    continue
                rate = 2 * RATE / len(slot)
                if (slot[0] == slot[0, 0]).all():
                    b = slot[0, 0]
                    n[b] += len(grad)
                    table[b] -= grad.sum(0) * np.float32(rate / np.sqrt(len(grad) * n[b]))
                    slot = slot[1:]
                u, c, change = by_slot(slot, grad)
                n[u] += c
                change *= (rate / np.sqrt(c * n[u]))[:, None].astype(np.float32)
                table[u] = table.take(u, 0) - change


def by_slot(slot: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct slots of (features, rows), how often each occurs, and the sums of their rows of ``grad``."""
    flat = slot.ravel()
    order = np.argsort(flat, kind="stable")  # a radix sort, as slots have 16 bits
    at = flat[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    c = np.diff(np.append(first, len(at)))
    most = np.argsort((-c).astype(np.uint16), kind="stable")  # those that occur most come first
    first, c, row = first[most], c[most], order % len(grad)
    out = grad.take(row[first], 0)
    more = np.searchsorted(-c, -np.arange(1, NEAR + 1))  # how many occur more than once, twice and so on
    for k, m in enumerate(more[:-1], 1):
        if m:
            out[:m] += grad.take(row[first[:m] + k], 0)
    if m := more[-1]:
        left = c[:m] - NEAR
        cut = np.cumsum(left) - left
        out[:m] += np.add.reduceat(grad.take(row[np.arange(left.sum()) + np.repeat(first[:m] + NEAR - cut, left)], 0), cut, axis=0)
    return at[first], c, out


def _entries(docs: DataFrame, key: np.ndarray) -> DataFrame:
    """(word, times): which words of ``key`` each text holds (16 bits each), and how often (32 bits each). Texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in slices(off, SLICE):
                token, begin = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                one, back = np.unique(token, return_inverse=True)
                at = np.minimum(np.searchsorted(key, one), len(key) - 1)
                known, at = (key[at] == one)[back], at[back]
                cell, n = np.unique((np.repeat(np.arange(hi - lo), np.diff(begin)) * len(key) + at)[known], return_counts=True)
                size = np.bincount(cell // len(key), minlength=hi - lo)
                cut = np.append(0, np.cumsum(size[size > 0]))
                made = [pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in ((cell % len(key)).astype(np.uint16), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, names=["word", "times"])

    return docs.select("text").mapInArrow(run, "word binary, times binary")


def _sum(texts: DataFrame, step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all texts of the rows of whole numbers that ``step(word, times, begin)`` gives for some of them."""

    def column(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        value = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind)
        return value, (off - off[0]) // value.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            (word, off), (times, _) = column(batch.column(0), np.uint16), column(batch.column(1), np.int32)
            for lo, hi in slices(off, ENTRIES):
                part = slice(off[lo], off[hi])
                made = step(word[part].astype(np.int64), times[part], off[lo : hi + 1] - off[lo])
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([row.astype(np.float64).tobytes() for row in total], pa.binary())], names=["row", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in rows["sums"])
        return pa.table({"row": rows["row"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    found = texts.mapInArrow(run, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect()
    return np.stack([np.frombuffer(r.sums, np.float64) for r in sorted(found, key=lambda r: r.row)])


def _topics(docs: DataFrame, key: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words and their log odds in each topic (words, topics), by spherical k-means over all texts. ``key``: the words."""
    key, width = np.sort(key), len(key)
    if not width:
        return key, np.zeros((0, TOPICS))
    texts = scratch.save(_entries(docs, key), "entries")
    held, n = _sum(texts, lambda word, times, begin: np.stack([np.bincount(word, minlength=width), np.bincount([0], [len(begin) - 1], width)]))
    idf = np.log((n[0] + 1) / (held + 1))

    def spread(onto: np.ndarray) -> np.ndarray:
        def step(word: np.ndarray, times: np.ndarray, begin: np.ndarray) -> np.ndarray:
            x = unit(word, times, begin, idf)
            far = np.repeat(project(x, word, begin, onto), np.diff(begin), axis=0)
            return np.stack([np.bincount(word, np.rint(x * f * UNIT), width) for f in far.T])

        return np.linalg.qr(_sum(texts, step).T)[0]

    def grouped(centres: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def step(word: np.ndarray, times: np.ndarray, begin: np.ndarray) -> np.ndarray:
            x = unit(word, times, begin, idf)
            return by_topic(value(x, times), word, begin, project(x, word, begin, centres).argmax(1), width)

        return _sum(texts, step)

    onto = np.linalg.qr(numbers(width * TOPICS, 7).reshape(width, TOPICS) / 2.0**64 - 0.5)[0]
    for _ in range(TURNS):
        onto = spread(onto)
    centres, last = first_centres(onto), None
    for _ in range(PASSES):
        sums = grouped(centres, lambda x, times: np.rint(x * UNIT))
        if last is not None and np.array_equal(sums, last):
            break
        size = np.sqrt((sums * sums).sum(1))
        centres, last = np.where(size > 0, sums.T / np.maximum(size, 1), centres), sums
    share = grouped(centres, lambda x, times: times) + 0.5
    scratch.drop("entries")
    share = share / share.sum(1, keepdims=True)
    return key, np.log(share / share.mean(0)).T


def _count(docs: DataFrame) -> DataFrame:
    """(token, n) of all tokens of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in slices(off, SLICE):
                key, n = np.unique(tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _topic_of_words(docs: DataFrame, table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """The topic of each word of ``key`` (sorted): that of most of its occurrences in the training texts."""
    shared = docs.sparkSession.sparkContext.broadcast((table, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key = shared.value
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in slices(off, SLICE):
                token, begin = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                one, back = np.unique(token, return_inverse=True)
                topic = np.repeat(topic_of(one, back, begin, table), np.diff(begin))
                n = np.bincount(back * TOPICS + topic, minlength=len(one) * TOPICS).reshape(-1, TOPICS)
                at = np.minimum(np.searchsorted(key, one), len(key) - 1)
                known = key[at] == one
                row, of = np.nonzero(n * known[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(at[row], pa.int32()), pa.array(n[row, of], pa.int64()), pa.array(of.astype(np.int32))], names=["word", "n", "topic"])

    out = np.zeros(len(key), np.int64)
    if len(key) and len(table[0]):
        found = docs.select("text").mapInArrow(run, "word int, n long, topic int")
        each = [F.sum(F.when(F.col("topic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in range(TOPICS)]
        of = F.array(*[f"n{t}" for t in range(TOPICS)])
        most = found.groupBy("word").agg(*each).select("word", (F.array_position(of, F.array_max(of)) - 1).cast("int").alias("topic")).toArrow()
        out[most["word"].to_numpy()] = most["topic"].to_numpy()
    shared.destroy()
    return out


def _train(docs: DataFrame, words: Broadcast, total: int) -> Model:
    """One pass over the training texts, in ROUNDS parts of them."""
    spark = docs.sparkSession
    model = Model(words.value)
    model.begin(total)
    width = SLOTS // BLOCKS
    for r in range(ROUNDS):
        now = spark.sparkContext.broadcast((model.outer, model.inner))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            first = now.value
            own, seen = Model(words.value, *first), (np.zeros(SLOTS), np.zeros(SLOTS))
            any_ = False
            for batch in batches:
                data, off = text_buffers(batch.column(0))
                for lo, hi in slices(off, SLICE):
                    own.update(*tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), seen)
                    any_ = True
            if any_:
                for t, (after, before, n) in enumerate(((own.outer, first[0], seen[0]), (own.inner, first[1], seen[1]))):
                    for b in range(BLOCKS):
                        part = slice(b * width, (b + 1) * width)
                        hit = np.flatnonzero(n[part])
                        if len(hit):  # half precision is enough for what is averaged
                            yield pa.RecordBatch.from_arrays([pa.array([t * BLOCKS + b], pa.int32()), pa.array([hit.astype(np.uint16).tobytes()], pa.binary()), pa.array([(after[part] - before[part])[hit].astype(np.float16).tobytes()], pa.binary())], names=["block", "slots", "change"])

        def mean(rows: pa.Table) -> pa.Table:
            total, n = None, np.zeros(width)
            for at, change in zip(rows["slots"], rows["change"], strict=True):
                at, change = np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(change.as_buffer(), np.float16)
                total = np.zeros((width, len(change) // len(at))) if total is None else total
                total[at] += change.reshape(len(at), -1)
                n[at] += 1
            return pa.table({"block": rows["block"].slice(0, 1), "change": pa.array([(total / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())})

        part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r).select("text")
        changes = part.mapInArrow(run, "block int, slots binary, change binary").groupBy("block").applyInArrow(mean, "block int, change binary")
        for row in changes.collect():  # the weights, of a fixed size
            t, b = divmod(row.block, BLOCKS)
            table = (model.outer, model.inner)[t]
            table[b * width : (b + 1) * width] += np.frombuffer(row.change, np.float32).reshape(width, -1)
        now.destroy()  # else its copies stay on the disks of the driver and of all executors
    return model


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", shared: int = SHARED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``training``: the condition of training documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(~training, F.lit(True)).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    counts = scratch.save(_count(learn), "counts")
    sizes = sorted(((r.k, r.v, r.n) for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()), reverse=True)
    total, distinct = sum(r[2] for r in sizes), sum(r[1] for r in sizes)
    learn = learn.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS)))  # what a task sends does not grow with its texts
    least, have = None, 0  # the least step of log2 n from which counts are broadcast
    for k, v, _ in sizes:
        if have + v > shared:
            break
        least, have = k, have + v
    often = counts.filter(F.floor(F.log2("n") * 8) >= least) if least is not None else counts.limit(0)
    table = often.select("token", "n").toArrow()
    key, n = table["token"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    top = counts.orderBy(F.desc("n"), "token").limit(TOPIC_WORDS).select("token").toArrow()["token"].to_numpy().view(np.uint64)
    topic, several = np.zeros(len(key), np.int64), n > 1
    topic[several] = _topic_of_words(learn, _topics(learn, top, scratch), key[several])
    words = Words(key, n, topic)
    shared_words = spark.sparkContext.broadcast(words)
    model = _train(learn, shared_words, total)
    known = spark.sparkContext.broadcast((model.outer, model.inner))
    free = words.member[:-1] < 0
    of = np.bincount(words.kind[:-1][free], words.n[:-1][free] + 1, OPEN)  # the smoothed counts of a class, shared by its words
    of[-1] += total - int(words.n.sum()) + distinct - have + 1  # rare words, and one for all new ones
    class_log = np.log10(np.maximum(of, 1))
    base_log = float(np.log10(total + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = Model(shared_words.value, *known.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in slices(off, SLICE):
                token, begin = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                kind, member, n = model.words.find(token)
                found, log_c = n > 0, np.log10(n + 1.0)
                logp = model.log10(token, begin, (kind, member)) + np.where(member < 0, log_c - class_log[kind], 0.0)
                sums = [np.add.reduceat(x, begin[:-1]) for x in (found.astype(np.int64), log_c, logp)]
                doc = np.repeat(np.arange(hi - lo), np.diff(begin))[~found]
                rare = token[~found]
                o = np.lexsort((rare, doc))
                first = np.flatnonzero(np.append(True, (np.diff(doc[o]) != 0) | (np.diff(rare[o]) != 0))) if len(o) else o
                times = np.diff(np.append(first, len(o)))
                cut = np.searchsorted(doc[o][first], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(row + np.arange(hi - lo)), pa.array(np.diff(begin)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(cut), pa.array(rare[o][first].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_known", "log_c", "score", "rare", "times"],
                )
                row += hi - lo

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = scratch.save(docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, log_c double, score double, rare array<long>, times array<int>"), "parts")
    shared_words.destroy()
    known.destroy()
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    seldom = counts.filter(F.floor(F.log2("n") * 8) < least) if least is not None else counts
    more = rare.join(seldom, "token").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_r"))
    out = part.drop("rare", "times").join(more, "row", "left")
    extra = F.coalesce("log_r", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") + extra - F.col("n_tokens") * base_log).alias("base_score"), (F.col("score") + extra).alias("score"),
    )
