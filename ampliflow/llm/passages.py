"""Passages of ``LENGTH`` words and more that different documents share, by sparse suffix arrays.

Suffixes are retained at minimisers: where the hash of ``GRAM`` words is least
among ``SPAN`` neighbouring positions, so equal passages retain equal suffixes.
A first pass counts the suffixes' first ``HEAD`` words (by a 64-bit hash). A
second sends those that several documents have with the words to their right
(up to ``LENGTH``) and left. The suffixes of a head are sorted by their words,
forwards and, for what comes before them, backwards; words common to
neighbours of either order tell which suffixes agree in any number of words to
the right and to the left. A match of a suffix extended by l words to the left
and to ``LENGTH`` words in all, in different documents, is a shared passage;
unions of these are the maximal ones. Any window of ``LENGTH`` words holds a
retained suffix at its l-th word for some l < ``SPAN``, so none is missed.

Heads of more than ``hot`` suffixes (or a millionth of all suffixes, if that
is more, so that their list is of bounded size) are never in one task: their
extended windows are compared by 64-bit hashes beside those of the heads, in
partial aggregates, and what is shared is joined back in salted parts.

Words are lower-cased (A-Z) and split by white space; words of over ``LONG``
bytes are compared by a 64-bit hash. Null texts and those of fewer words share
nothing; rows of one ``doc_id`` are one document, rows of a null id are left
out; an empty table gives no rows. Only the two named columns are read. Result:
a row for each document with shared passages: doc_id, n_shared (words),
passages (``start:end`` of words, comma-joined).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Scratch, mix, runs, slices, text_buffers, word_hashes, words

LENGTH, SPAN, GRAM = 50, 16, 4
HEAD = LENGTH - SPAN
HOT, MOST_HOT = 20_000, 1_000_000
LONG = 24
BITS = 30  # of the largest filter (128 MB)
TASK_ROWS = 100_000
_STEP = 0xD1342543DE82EF95


class Suffixes:
    """The retained suffixes of the texts of a slice."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end, self.first = words(self.low, off, NOT_SPACE)
        self.hash = h = word_hashes(self.low, self.start, self.end)
        n = len(h)
        power, self.back, self.sums = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        power[1:], self.back[1:] = _STEP, pow(_STEP, -1, 1 << 64)
        power, self.back = np.cumprod(power), np.cumprod(self.back)
        self.sums[1:] = np.cumsum(h * power[:n])
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.at = np.zeros(0, np.int64)
        if n >= LENGTH:
            gram = self.range(np.arange(n - GRAM + 1), GRAM)
            last = len(gram) - SPAN + 1
            if last > 0:
                least = np.lib.stride_tricks.sliding_window_view(gram, SPAN).argmin(1) + np.arange(last)
                inside = self.doc[:last] == self.doc[SPAN + GRAM - 2 : SPAN + GRAM - 2 + last]
                at = np.unique(least[inside])
                stop = self.first[1:][self.doc[at]]
                self.at = at[(at + HEAD <= stop) & (stop - self.first[self.doc[at]] >= LENGTH)]

    def range(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.back[at] + np.uint64(n))

    def heads(self) -> np.ndarray:
        return self.range(self.at, HEAD).view(np.int64)

    def around(self, some: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The words before each suffix, from its last one backwards and with their letters reversed, and those behind its head; each ended by a blank."""
        size = self.end - self.start
        long = size > LONG
        size = np.where(long, 17, size)
        stop = np.cumsum(size + 1)  # of a word's image in the line, which begins with a blank
        line = np.full(int(stop[-1]) + 1 if len(stop) else 1, 32, np.uint8)
        begin = stop - size
        w = np.flatnonzero(~long)
        shift = np.cumsum(size[w]) - size[w]
        pos = np.arange(int(size[w].sum()))
        line[pos + np.repeat(begin[w] - shift, size[w])] = self.low[pos + np.repeat(self.start[w] - shift, size[w])]
        for k in np.flatnonzero(long).tolist():
            line[begin[k] : begin[k] + 17] = np.frombuffer(b"\v%016x" % int(self.hash[k]), np.uint8)
        flat, turned, n = line.tobytes(), line[::-1].tobytes(), len(line)
        begin = np.append(begin, n)
        at = self.at[some]
        lo, hi = self.first[:-1][self.doc[at]], self.first[1:][self.doc[at]]
        a, b = begin[np.maximum(lo, at - SPAN + 1)], begin[at]
        left = [turned[n + 1 - y : n + 1 - x] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        c, d = begin[at + HEAD], begin[np.minimum(hi, at + LENGTH)]
        return left, [flat[x:y] for x, y in zip(c.tolist(), d.tolist(), strict=True)]

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the LENGTH words from each l to the left, and which of them lie in the text (as bits)."""
        at = self.at[some]
        lo, hi = self.first[:-1][self.doc[at]], self.first[1:][self.doc[at]]
        out, valid = np.zeros((len(at), SPAN), np.uint64), np.zeros(len(at), np.int64)
        for left in range(SPAN):
            begin = at - left
            ok = (begin >= lo) & (begin + LENGTH <= hi)
            out[ok, left] = self.range(begin[ok], LENGTH)
            valid |= ok.astype(np.int64) << left
        return out, valid


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``keys(key)``: of fixed size, gathered in parts."""
    part = max(0, bits - 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_slot(b.column(0).to_numpy(), bits) for b in batches if b.num_rows]
        slot = np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)
        of = (slot >> np.uint64(16)).astype(np.int64)
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        for lo, hi in zip(cut, np.append(cut, len(of))[1:], strict=True):
            flags = np.zeros(1 << 16, bool)
            flags[(slot[lo:hi] & np.uint64(0xFFFF)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "bits"])

    def either(rows: pa.Table) -> pa.Table:
        out = np.zeros(1 << 13, np.uint8)
        for v in rows["bits"]:
            out |= np.frombuffer(v.as_buffer(), np.uint8)
        return pa.table({"part": rows["part"].slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros((1 << part, 1 << 13), np.uint8)
    for r in keys.select("key").mapInArrow(run, "part long, bits binary").groupBy("part").applyInArrow(either, "part long, bits binary").coalesce(8).toLocalIterator():
        whole[r.part] = np.frombuffer(r.bits, np.uint8)
    return whole.ravel()


def _sorted(texts: pa.ChunkedArray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the classes (k, rows) of texts of one group that agree in their first ``least + k`` words.

    The texts of a group are sorted, and neighbours compared.
    """
    raw = texts.to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    wide = max(1, int(size.max(initial=0)))
    line = np.zeros((len(raw), wide), np.uint8)
    line[np.arange(wide) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    order = np.lexsort((line.view(f"S{wide}").ravel(), group))
    line, of = line[order], group[order]
    ended = np.cumsum(line == 32, axis=1, dtype=np.int16)
    differ = line[1:] != line[:-1]
    first = np.where(differ.any(1), differ.argmax(1), wide)
    common = np.where(first > 0, ended[np.arange(1, len(line)), np.maximum(first, 1) - 1], 0)
    common[of[1:] != of[:-1]] = -1
    n, classes = np.empty(len(raw), np.int64), np.empty((SPAN, len(raw)), np.int64)
    n[order] = ended[:, -1]
    for k in range(SPAN):
        classes[k, order] = np.concatenate([[0], np.cumsum(common < least + k)])
    return n, classes


def _shared(rows: pa.Table) -> pa.RecordBatch:
    """Of suffixes of whole groups: those with windows that another document has, and which (as bits)."""
    key, doc, at = (rows[c].to_numpy() for c in ("key", "doc_id", "at"))
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    some = np.flatnonzero(several[group])
    mask = np.zeros(len(key), np.int64)
    if len(some):
        rows, group = rows.take(pa.array(some)), group[some]
        behind, right = _sorted(rows["right"], group, 1)
        before, left = _sorted(rows["left"], group, 0)
        for x in range(SPAN):
            fits = np.flatnonzero((before >= x) & (behind >= SPAN - x))
            if len(fits) > 1:
                code = left[x, fits] * (len(some) + 1) + right[SPAN - x - 1, fits]
                order = np.argsort(code, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
                d = doc[some[fits[order]]]
                alike = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
                mask[some[fits[order]]] |= np.repeat(alike, np.diff(np.append(cut, len(order)))).astype(np.int64) << x
    k = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(at[k]), pa.array(mask[k])], names=["doc_id", "at", "mask"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal passages of each document, from its matched suffixes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column("found")
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
        at, mask = (found.flatten().field(c).to_numpy() for c in ("at", "mask"))
        k, left = np.nonzero(mask[:, None] >> np.arange(SPAN) & 1)
        place = np.unique(row[k] << 40 | at[k] - left)
        row, begin = place >> 40, place & (1 << 40) - 1
        new = np.append(True, (np.diff(row) != 0) | (np.diff(begin) > LENGTH))
        lo = np.flatnonzero(new)
        a, b, of = begin[lo], begin[np.append(lo[1:], len(row)) - 1] + LENGTH, row[lo]
        cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
        said = [f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.add.reduceat(b - a, cut[:-1])), pa.array([",".join(said[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "n_shared", "passages"])


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_shared, passages of the documents with shared passages."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in slices(off):
                s = Suffixes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([pa.array(s.heads()), pa.array(ids[lo + s.doc[s.at]])], names=["key", "doc_id"])

    counted = docs.mapInArrow(heads, "key long, doc_id long").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    often = scratch.save(counted.filter("a <> b").select("key", "n"), "often")
    bits = min(BITS, max(16, int(32 * often.count()).bit_length()))
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = max(hot, total // MOST_HOT)
    few = often.filter(F.col("n") > hot).orderBy("key").toArrow()  # at most MOST_HOT
    shared = spark.sparkContext.broadcast((_filter(often, bits), few["key"].to_numpy(), few["n"].to_numpy()))
    names = ["key", "doc_id", "at", "left", "right", "parts"]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, large, size = shared.value
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in slices(off):
                s = Suffixes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                key = s.heads()
                slot = _slot(key, bits)
                some = np.flatnonzero(passes[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8) & 1)
                doc, at = s.doc[s.at[some]], s.at[some]
                left, right = s.around(some)
                parts = np.zeros(len(some), np.int64)
                if len(large):  # how many parts a hot head needs (0: none)
                    k = np.minimum(np.searchsorted(large, key[some]), len(large) - 1)
                    parts = np.where(large[k] == key[some], size[k] // hot + 1, 0)
                    for x, w, v in zip(np.flatnonzero(parts).tolist(), *s.windows(some[parts > 0]), strict=True):
                        left[x], right[x] = w.tobytes(), int(v).to_bytes(8, "little")
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(ids[lo + doc]), pa.array(at - s.first[doc]), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(parts)], names=names)

    rows = docs.mapInArrow(suffixes, "key long, doc_id long, at long, left binary, right binary, parts long")
    rows = scratch.save(rows, "suffixes") if len(few) else rows  # read twice
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in runs(batches, 1):
            held.append(group)
            n += len(group)
            if n >= 30_000:
                yield _shared(pa.concat_tables(held))
                held, n = [], 0
        if held:
            yield _shared(pa.concat_tables(held))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            win = np.frombuffer(b"".join(batch.column("left").to_pylist()), np.int64).reshape(-1, SPAN)
            valid = np.frombuffer(b"".join(batch.column("right").to_pylist()), np.int64)
            key, doc, at, parts = (batch.column(c).to_numpy() for c in ("key", "doc_id", "at", "parts"))
            salt = (mix(doc.view(np.uint64) + mix(at.view(np.uint64))) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
            for x in range(SPAN):
                k = np.flatnonzero(valid >> x & 1)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[k], win[k, x], salt[k], parts[k], doc[k], at[k], np.full(len(k), 1 << x))], names=["key", "window", "salt", "parts", "doc_id", "at", "mask"])

    found = rows.filter("parts = 0").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(compare, "doc_id long, at long, mask long")
    if len(few):
        one = scratch.save(rows.filter("parts > 0").mapInArrow(apart, "key long, window long, salt long, parts long, doc_id long, at long, mask long"), "hot")
        alike = one.groupBy("key", "window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("parts").alias("parts")).filter("a <> b")
        alike = alike.select("key", "window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        found = found.unionByName(one.join(alike, ["key", "window", "salt"], "left_semi").select("doc_id", "at", "mask"))
    per = found.groupBy("doc_id").agg(F.collect_set(F.struct("at", "mask")).alias("found"))
    return per.mapInArrow(_spans, "doc_id long, n_shared long, passages string")
