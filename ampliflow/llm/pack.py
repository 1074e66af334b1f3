"""Cost-balanced packing of documents into training sequences.

A document's tokens are those of the tokenizer, then one end token. Documents
longer than a sequence give whole sequences; what is left of all documents of
a group is assigned in descending length to the sequence of lowest estimated
cost (linear + quadratic in the lengths of its pieces) that still has room.
A piece that fits nowhere whole is cut to fill the sequences of least cost, so
only the last sequence of a group is not full, and that one is split at powers
of two, which need no padding. A group is a bounded number of tokens of one
task, so memory is bounded and no shuffle is needed.

Null or empty text: the end token alone. Repeated rows are packed each.
Result: one row per piece; start, offset and lengths in tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers
from .tokens import loaded

SEQUENCE = 4096
GROUP_TOKENS = 4 << 20
LINEAR, QUADRATIC = 4096.0, 1.0  # cost of a piece of n tokens: LINEAR n + QUADRATIC n^2


def assign(lengths: np.ndarray, size: int = SEQUENCE) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) for items of at most ``size`` tokens each."""
    total = int(lengths.sum())
    full, rest = divmod(total, size)
    room = [size] * full + [1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1]
    room_at, cost = np.array(room, np.int64), np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    waiting = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = np.flatnonzero(room_at >= n)
        if not len(fits):
            waiting.append(i)
            continue
        s = int(fits[np.argmin(cost[fits])])
        yield i, 0, n, s, int(used[s])
        cost[s] += LINEAR * n + QUADRATIC * n * n
        used[s] += n
        room_at[s] -= n
    for i in waiting:  # cut to fill what is left, cheapest sequences first
        at, n = 0, int(lengths[i])
        open_ = np.flatnonzero(room_at > 0)
        for s in open_[np.argsort(cost[open_], kind="stable")].tolist():
            part = min(n - at, int(room_at[s]))
            if part:
                yield i, at, part, s, int(used[s])
                cost[s] += LINEAR * part + QUADRATIC * part * part
                used[s] += part
                room_at[s] -= part
                at += part
            if at == n:
                break


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = SEQUENCE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def emit(ids: list, blobs: list[bytes], base: int, rows: list) -> int:
        """Pack a group; the number of its sequences."""
        pieces, n_seq = [], 0
        for d, blob in enumerate(blobs):
            n = len(blob) // 4
            for k in range(n // size):
                rows.append((ids[d], k * size, size, zlib.crc32(blob[4 * k * size : 4 * (k + 1) * size]), n, base + n_seq, 0))
                n_seq += 1
            if n % size:
                pieces.append((d, n - n % size, n % size))
        if pieces:
            top = 0
            for i, at, length, seq, offset in assign(np.array([p[2] for p in pieces], np.int64), size):
                d, start, _ = pieces[i]
                start += at
                rows.append((ids[d], start, length, zlib.crc32(blobs[d][4 * start : 4 * (start + length)]), len(blobs[d]) // 4, base + n_seq + seq, offset))
                top = max(top, seq + 1)
            n_seq += top
        return n_seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base = loaded(tokenizer), TaskContext.get().partitionId() << 40
        id_type = None

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, *names])

        ids, blobs, held = [], [], 0
        for batch in batches:
            id_type = batch.column(0).type
            _, off = text_buffers(batch.column(1))
            for lo, hi in slices(off):
                keys, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
                for key, got in zip(keys, bpe.encode(texts), strict=True):
                    ids.append(key)
                    blobs.append(got.tobytes() + end)
                    held += len(got) + 1
                    if held >= group_tokens:
                        rows: list = []
                        base += emit(ids, blobs, base, rows)
                        yield out(rows)
                        ids, blobs, held = [], [], 0
        if ids:
            rows = []
            emit(ids, blobs, base, rows)
            yield out(rows)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` long" for n in names)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
