"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text becomes `` w1 w2 ... wn `` of its lower-cased words with one space
between and around them, and a window of an item likewise, so a window occurs
exactly where its bytes occur. Blocks of up to 8 bytes index a shift table;
where the shift is 0, the hash of the block that ends a window's first m bytes
selects a bucket of windows, and their bytes are compared. Many cursors, one
per segment of text, advance at once in numpy.

Windows are places in the items' text, not copies of it. Distinct items are
searched in blocks of at most ``block_bytes`` of text and ids (one larger item
makes a block of its own): a worker holds the compressed items of a part and
the tables of one block at a time, and takes each held ``HELD`` bytes of texts
through all blocks. A benchmark of more than ``part_bytes`` is searched in
parts, one scan each, which carry the hits so far in a written table.

Null text or no word: no window, no hit; so are all texts for an empty
benchmark. Items of a null id count for hits but are not listed. Repeated items
count once (by id); repeated documents give a row each; an empty table gives
none. Input columns that clash with result columns give way to them.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORD, Scratch, mix, slices, text_buffers, word_hashes, words

WINDOW = 13
BLOCK_BYTES = 4 << 20
PART_BYTES = 256 << 20
HELD = 32 << 20
SEGMENT = 4096
_MULT = np.uint64(0x9E3779B97F4A7C15)


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as spaced words, each ended by a line feed; where each word begins in that; first word of each text."""
    start, end, first = words(data, off, WORD)
    size = end - start
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    before = np.cumsum(size) - size
    at = before + np.arange(1, len(size) + 1) + 2 * doc
    out = np.full(int(size.sum()) + len(size) + 2 * (len(off) - 1), 32, np.uint8)
    if len(size):
        pos = np.arange(int(size.sum()))
        out[pos + np.repeat(at - before, size)] = LOWER[data[pos + np.repeat(start - before, size)]]
    kept = np.concatenate([[0], np.cumsum(size)])[first[1:]]
    out[kept + first[1:] + 2 * np.arange(len(off) - 1) + 1] = 10
    return out, at, first


class Windows:
    """The distinct windows of items: places ``start`` and ``size`` in ``flat``, words ``width``, and the items of each."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        raw = [(t or "").encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        self.flat, at, first = spaced(np.frombuffer(b"".join(raw), np.uint8), off)
        n = np.diff(first)
        width = np.minimum(n, window)
        count = np.where(n > 0, n - width + 1, 0)
        item = np.repeat(np.arange(len(texts)), count)
        word = np.repeat(first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        after = word + width[item]
        last = first[1:][item]
        edge = np.append(at, len(self.flat))
        stop = np.where(after < last, edge[np.minimum(after, len(at))] - 1, 0)
        ends = np.flatnonzero(self.flat == 10) - 1  # the space after the last word of each item
        stop = np.where(after < last, stop, ends[item] if len(item) else 0)
        start = at[word] - 1 if len(word) else word
        # equal windows, by a 64-bit hash of their bytes and then by the bytes
        h = word_hashes(self.flat, at, np.append(at[1:] - 1, len(self.flat) - 2)) if len(at) else np.zeros(0, np.uint64)
        sums = np.zeros(len(word), np.uint64)
        for k in range(window):
            inside = k < width[item]
            sums[inside] = mix(sums[inside] + h[word[inside] + k] + np.uint64(k + 1))
        order = np.argsort(sums, kind="stable")
        same = np.zeros(len(order), bool)
        flat = self.flat.tobytes()
        tied = np.flatnonzero(sums[order][1:] == sums[order][:-1]) + 1
        for k in tied.tolist():
            a, b = order[k - 1], order[k]
            same[k] = flat[start[a] : stop[a] + 1] == flat[start[b] : stop[b] + 1]
        head = order[~same]
        self.start, self.size, self.width = start[head], stop[head] + 1 - start[head], width[item][head]
        self.cut = np.append(np.flatnonzero(~same), len(order))
        self.items = item[order]


class WuManber:
    """Search for many byte strings at once: ``flat[start : start + size]``. Strings of very different lengths get tables of their own."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.bytes, self.start, self.size = flat.tobytes(), start, size
        self.view = np.ndarray(len(flat), "<u8", self.bytes + bytes(8), 0, (1,))
        group = np.minimum(np.ceil(np.log2(np.maximum(size, 1) + 1)).astype(np.int64), 7)
        self.groups = [self._tables(np.flatnonzero(group == g)) for g in np.unique(group)]

    def _tables(self, ids: np.ndarray) -> tuple:
        m = int(self.size[ids].min())
        b = min(8, m)
        mask = np.uint64((1 << (8 * b)) - 1)
        shift = np.full(1 << 18, m - b + 1, np.int32)
        for j in range(b, m + 1):
            last = (((self.view[self.start[ids] + j - b] & mask) * _MULT) >> np.uint64(46)).astype(np.int32)
            np.minimum.at(shift, last, m - j)
        order = np.argsort(last, kind="stable")
        ids = ids[order]
        return m, b, mask, shift, last[order], ids, self.view[self.start[ids]] & mask

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: positions, and indices of strings."""
        n, flat = len(text), text.tobytes()
        view = np.ndarray(n, "<u8", flat + bytes(8), 0, (1,))
        where, which = [], []
        for m, b, mask, shift, slots, ids, front in self.groups:
            start = np.arange(0, n, SEGMENT)
            at, stop = start + m, np.minimum(start + SEGMENT - 1 + m, n)
            while True:
                live = at <= stop
                if not live.all():
                    at, stop = at[live], stop[live]
                if not len(at):
                    break
                slot = (((view[at - b] & mask) * _MULT) >> np.uint64(46)).astype(np.int64)
                step = shift[slot]
                hit = np.flatnonzero(step == 0)
                if len(hit):
                    lo, hi = np.searchsorted(slots, slot[hit], "left"), np.searchsorted(slots, slot[hit], "right")
                    size = hi - lo
                    member = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                    begin = np.repeat(at[hit] - m, size)
                    same = (view[begin] & mask) == front[member]
                    for s, i in zip(begin[same].tolist(), ids[member[same]].tolist(), strict=True):
                        p, k = self.start[i], self.size[i]
                        if flat[s : s + k] == self.bytes[p : p + k]:
                            where.append(s)
                            which.append(i)
                at = at + np.maximum(step, 1)
        return np.array(where, np.int64), np.array(which, np.int64)


class _Block:
    """The tables of a block of items: (text, ids) pairs."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.ids, self.window = [i for _, i in items], window
        self.windows = Windows([t for t, _ in items], window)
        self.tables = WuManber(self.windows.flat, self.windows.start, self.windows.size)

    def mark(self, line: np.ndarray, at: np.ndarray, first: np.ndarray, edge: np.ndarray, of: list[set], whole: np.ndarray) -> None:
        """Add what occurs in spaced texts: to the edges of hit words, the ids of each text, and its whole windows."""
        where, which = self.tables.search(line)
        if not len(where):
            return
        w = self.windows
        word = np.searchsorted(at, where + 1)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + w.width[which], -1)
        doc = np.searchsorted(first, word, "right") - 1
        np.add.at(whole, doc, w.width[which] == self.window)
        for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            for k in w.items[w.cut[p] : w.cut[p + 1]].tolist():
                of[d].update(self.ids[k])


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("n_whole", T.LongType()),
]
_SO_FAR = T.StructField("_hits_so_far", T.BinaryType())  # between parts: hit words (as bits), ids, whole windows


def _parts(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, part_bytes: int) -> Iterator[list[bytes]]:
    """Compressed blocks of distinct texts with their ids, in parts of at most ``part_bytes``; fetched a partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    part, block, size, held = [], [], 0, 0
    for r in rows.groupBy("t").agg(F.collect_set("i").alias("ids")).toLocalIterator():
        n = len(r.t.encode()) + sum(len(i) + 8 for i in r.ids)
        if block and size + n > block_bytes:
            part.append(zlib.compress(pickle.dumps(block), 1))
            block, size = [], 0
            if held + n > part_bytes:
                yield part
                part, held = [], 0
        block.append((r.t, r.ids))
        size, held = size + n, held + n
    if block:
        part.append(zlib.compress(pickle.dumps(block), 1))
    yield part


def _search(docs: DataFrame, text_col: str, blocks: list[bytes], window: int, more: bool, last: bool, keep: list[str] | None) -> DataFrame:
    """``docs`` with what a part of the benchmark adds to the hits so far; the result columns with the last part."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    fields = FIELDS if last else [_SO_FAR]
    gone = {f.name.lower() for f in FIELDS} | ({"_hits_so_far"} if more or not last else set())
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone and (keep is None or f.name in keep or (not last and f.name == text_col))]
    single: list = []

    def tables() -> Iterator[_Block]:
        if len(shared.value) == 1:  # kept for all batches
            if not single:
                single.append(_Block(pickle.loads(zlib.decompress(shared.value[0])), window))
            yield single[0]
        else:
            for blob in shared.value:
                yield _Block(pickle.loads(zlib.decompress(blob)), window)

    def searched(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
        before = batch.column(batch.schema.get_field_index("_hits_so_far")).to_pylist() if more else None
        lines = []
        for lo, hi in slices(off):
            line, at, first = spaced(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lines.append((lo, line, at, first, np.zeros(len(at) + 1, np.int64), [set() for _ in range(hi - lo)], np.zeros(hi - lo, np.int64)))
        for block in tables():
            for _, *state in lines:
                block.mark(*state)
        made: dict[str, list] = {f.name: [] for f in fields}
        for lo, _, _, first, edge, of, whole in lines:
            hit = np.cumsum(edge[:-1]) > 0
            for d, ids in enumerate(of):
                own = hit[first[d] : first[d + 1]]
                if more:
                    bits, old, n = pickle.loads(before[lo + d])
                    own |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
                    ids |= old
                    whole[d] += n
                if not last:
                    made["_hits_so_far"].append(pickle.dumps((np.packbits(own).tobytes(), ids, int(whole[d]))))
                    continue
                n, h, names = len(own), int(own.sum()), sorted(ids)
                for c, v in zip(made, (n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0 and 20 * h >= n, names, int(whole[d])), strict=True):
                    made[c].append(v)
        arrays = [pa.array(made[f.name], _ARROW[f.name]) for f in fields]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + arrays, names=[f.name for f in [*kept, *fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(shared.value) == 1 or size >= HELD:
                yield from map(searched, pa.Table.from_batches(held).combine_chunks().to_batches())
                held, size = [], 0
        if held:
            yield from map(searched, pa.Table.from_batches(held).combine_chunks().to_batches())

    return docs.mapInArrow(run, T.StructType([*kept, *fields]))


_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "item_ids": pa.list_(pa.string()), "n_whole": pa.int64(), "_hits_so_far": pa.binary()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, item_ids and n_whole: occurrences of windows of ``window`` words (see the module)."""
    scratch, now, more = None, docs, False
    parts = _parts(benchmark, item_id, item_text, block_bytes, part_bytes)
    part = next(parts)
    for k in range(1 << 30):
        after = next(parts, None)
        now = _search(now, text_col, part, window, more, after is None, keep)
        if after is None:
            return now
        scratch = scratch or Scratch(docs.sparkSession)
        now, more, part = scratch.save(now, f"part{k}"), True, after
