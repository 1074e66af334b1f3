"""Token ids of many texts at once for the word-level BPE tokenizer of a tokenizers file.

The file's own steps (NFC, white space, lower case; runs of letters, single
digits, runs of others; merges inside a run) are applied to all texts of a
slice together in numpy: each distinct run is merged once and remembered for
later slices. Texts that name a special token, or hold a code point that
Python's tables do not know (the tokenizer's are of another Unicode version),
go to the tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np

from .common import mix

KNOWN_RUNS = 500_000  # runs remembered by a worker
_LOADED: dict[str, Bpe] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if visible in Latin-1, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """0 white space, 1 letter, 2 number, 3 other, for each code point; and which are unknown."""
    kind, unknown = np.full(0x110000, 3, np.uint8), np.zeros(0x110000, bool)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        unknown[c] = k == "Cn"
        if k[0] in "LNZ":
            kind[c] = "ZLN".index(k[0])
    kind[[9, 10, 11, 12, 13, 0x85]] = 0
    return kind, unknown


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = np.append(key[order], 1 << 40), np.append(order, 0), made
        self.kind, self.unknown = _classes()
        self.known: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], 1 << 30)

    def merge(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs one after the other, and the number of each."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.frombuffer(b"".join(runs), np.uint8)
        sym = self.first[flat]
        end = np.cumsum(size) - 1
        sym[end] = self.last[flat[end]]
        run = np.repeat(np.arange(len(runs)), size)
        out_sym, out_run = [], []
        none = 1 << 30
        pair = np.append(self.ranks(sym[:-1], sym[1:]), none)  # of each symbol with the next
        pair[end] = none
        while len(sym):
            start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            length = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(pair << 32 | np.arange(len(sym)), start)
            over = (best >> 32) == none
            if over.any():
                gone = np.repeat(over, length)
                out_sym.append(sym[gone])
                out_run.append(run[gone])
                stay = ~gone
                renumber = np.cumsum(stay) - 1
                at = renumber[(best & 0xFFFFFFFF)[~over]]
                sym, run, pair = sym[stay], run[stay], pair[stay]
            else:
                at = best & 0xFFFFFFFF
            if not len(at):
                break
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes for each merge before
            sym, run, pair = sym[keep], run[keep], pair[keep]
            last = np.append(run[1:] != run[:-1], True)
            nxt = np.minimum(at + 1, len(sym) - 1)
            pair[at] = np.where(last[at], none, self.ranks(sym[at], sym[nxt]))
            before = at[(at > 0) & (run[at] == run[at - 1])]
            pair[before - 1] = self.ranks(sym[before - 1], sym[before])
        if not out_sym:
            return np.zeros(0, np.uint32), np.zeros(len(runs), np.int64)
        all_run = np.concatenate(out_run)
        order = np.argsort(all_run, kind="stable")
        return np.concatenate(out_sym)[order].astype(np.uint32), np.bincount(all_run, minlength=len(runs))

    def learn(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        """Remember runs not known yet."""
        ids, size = self.merge(runs)
        at = np.cumsum(size) - size + len(self.ids)
        order = np.argsort(np.concatenate([self.hash, hashes]), kind="stable")
        self.hash = np.concatenate([self.hash, hashes])[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, ids])

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hash, hashes), max(len(self.hash) - 1, 0))
        return at, self.hash[at] == hashes if len(self.hash) else np.zeros(len(hashes), bool)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text."""
        import pandas as pd

        texts = [t or "" for t in texts]
        odd = lambda t: not t.isascii() and self.unknown[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any()
        own = {i for i, t in enumerate(texts) if any(s in t for s in self.special) or odd(t)}
        plain = ["" if i in own else t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for i, t in enumerate(texts)]
        joined = "\n".join(plain) + "\n"
        point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        kind = self.kind[point]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        begin = (kind != 0) & ((kind != before) | (kind == 2))
        tick = np.flatnonzero((point == 39) & (before != 3))
        tick = tick[tick + 2 < len(point)]
        if len(tick):
            a, b = point[tick + 1], point[tick + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for which, n in ((one, 2), (two, 3)):
                p = tick[which]
                begin[p + 1] = False
                p = p[p + n < len(point)]
                begin[p + n] |= kind[p + n] == 1
        start = np.flatnonzero(begin)
        if len(start):
            stop = np.flatnonzero((kind != 0) & (np.append(begin[1:], True) | (np.append(kind[1:], 0) == 0))) + 1
            length = stop - start
            shift = np.cumsum(length) - length
            pos = np.arange(int(length.sum())) - np.repeat(shift, length)
            value = mix(point[pos + np.repeat(start, length)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            code, distinct = pd.factorize(mix(np.add.reduceat(value, shift) + length.astype(np.uint64)))
            if len(self.hash) + len(distinct) > KNOWN_RUNS:
                self.forget()
            _, known = self.places(distinct)
            if not known.all():
                some = np.zeros(len(distinct), np.int64)
                some[code[::-1]] = np.arange(len(code))[::-1]  # a place of each
                new = some[~known]
                self.learn(distinct[~known], [joined[s:e].encode() for s, e in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            at, _ = self.places(distinct)
            size = self.size[at][code]
            begin_at = np.cumsum(size) - size
            ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.at[at][code] - begin_at, size)]
            cut = np.append(begin_at, len(ids))[np.searchsorted(start, np.concatenate([[0], ends]))]
        else:
            ids, cut = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        for i in range(len(texts)):
            yield np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in own else ids[cut[i] : cut[i + 1]]


def loaded(path: str) -> Bpe:
    """The tokenizer of a file, kept by a Python worker from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
