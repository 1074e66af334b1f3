"""The divisive denoiser of one sample: uniques in, clusters out."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .align import align, substitutions


@dataclass(frozen=True)
class Options:
    omega_a: float = 1e-40
    omega_c: float = 1e-40
    omega_p: float = 1e-4
    detect_singletons: bool = False
    use_kmers: bool = True
    kdist_cutoff: float = 0.42
    max_clust: int = 0
    min_fold: float = 1
    min_hamming: int = 1
    min_abundance: int = 1
    match: int = 5
    mismatch: int = -4
    gap: int = -8
    run_gap: int | None = None
    band: int = 16
    use_quals: bool = True
    gapless: bool = True
    greedy: bool = True


MAX_SHUFFLE, K = 10, 5


def upper_tail(k: int, mean: float) -> float:
    """P(X >= k) of a Poisson variable, to convergence in either direction."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if k > mean:
        term, total, i = 1.0, 1.0, k
        while term > total * 1e-17:
            i += 1
            term *= mean / i
            total += term
        return math.exp(min(0.0, k * math.log(mean) - mean - math.lgamma(k + 1) + math.log(total)))
    term, total, i = 1.0, 1.0, k - 1
    while i > 0 and term > total * 1e-17:
        term *= i / mean
        total += term
        i -= 1
    return max(0.0, 1.0 - math.exp(min(0.0, (k - 1) * math.log(mean) - mean - math.lgamma(k) + math.log(total))))


def abundance_p(reads: int, mean: float, prior: bool = False) -> float:
    """Probability of as many reads or more, given that there is one unless ``prior``."""
    if mean <= 0:
        return 0.0
    p = upper_tail(reads, mean)
    if not prior:
        p /= mean - mean * mean / 2 if mean < 1e-7 else -math.expm1(-mean)
    return min(1.0, p)


class Sample:
    """Uniques in their order: sequences, reads and mean qualities, compared with centres under an error matrix."""

    def __init__(self, seqs: list[str], reads: list[int], quals: list, err: np.ndarray, options: Options, priors: set[str] | None = None):
        self.seqs, self.reads, self.err, self.o = seqs, np.array(reads, np.int64), err, options
        self.prior = np.array([s in (priors or set()) for s in seqs])
        self.quals = [np.clip(np.floor(np.array(q, float) + 0.5).astype(int), 0, err.shape[1] - 1) if q is not None and options.use_quals else np.zeros(len(s), int) for s, q in zip(seqs, quals, strict=True)]
        code = {65: 0, 67: 1, 71: 2, 84: 3}
        if bad := sum(any(ord(c) not in code for c in s) for s in seqs):
            raise ValueError(f"{bad} sequences hold letters other than A, C, G, T")
        self.codes = [np.array([code[b] for b in s.encode()], np.int64) for s in seqs]
        self.order = [self._kmers(c) for c in self.codes]
        self.counts = np.array([np.bincount(k, minlength=4**K) for k in self.order])

    @staticmethod
    def _kmers(code: np.ndarray) -> np.ndarray:
        return sum((code[i : len(code) - K + 1 + i] * 4 ** (K - 1 - i) for i in range(K)), np.zeros(max(0, len(code) - K + 1), np.int64))

    def compare(self, centre: int, members: np.ndarray, cutoff: float) -> dict[int, tuple[float, int, np.ndarray]]:
        """For each member near the centre: rate, mismatches, and transitions (4 * from + to) by position (-1: none)."""
        size = np.array([len(self.seqs[i]) for i in members]) if len(members) else np.zeros(0, int)
        least = np.minimum(size, len(self.seqs[centre])) - K + 1
        shared = np.minimum(self.counts[members], self.counts[centre]).sum(1)
        near = (1 - shared / np.maximum(least, 1) <= cutoff) if self.o.use_kmers else np.ones(len(members), bool)
        out, todo = {}, []
        for i, s, n in zip(members[near].tolist(), shared[near].tolist(), least[near].tolist(), strict=True):
            same = int((self.order[i][:n] == self.order[centre][:n]).sum())
            if self.o.band == 0 or (self.o.gapless and same == s and len(self.seqs[i]) == len(self.seqs[centre])):
                out[i] = self._rate(i, self.codes[centre] * 4 + self.codes[i])
            else:
                todo.append(i)
        for i, (x, y) in zip(todo, align([(self.seqs[centre], self.seqs[i]) for i in todo], self.o.match, self.o.mismatch, self.o.gap, self.o.band, run_gap=self.o.run_gap), strict=True):
            at, change = 0, self.codes[i] * 5  # a letter the centre lacks counts as unchanged
            for p, q in zip(x, y, strict=True):
                if q != "-":
                    if p != "-":
                        change[at] = 4 * "ACGT".index(p) + "ACGT".index(q)
                    at += 1
            out[i] = self._rate(i, change)
        return out

    def _rate(self, i: int, change: np.ndarray) -> tuple[float, int, np.ndarray]:
        return float(np.prod(self.err[change, self.quals[i]])), int((change % 5 != 0).sum()), change

    def run(self) -> dict:
        o, n = self.o, len(self.seqs)
        total = int(self.reads.sum())
        label, lock, best_e = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, -999.0)
        stored: list[dict[int, tuple[float, int]]] = []
        rates = np.full((0, n), -1.0)  # of each cluster and unique; -1: not compared
        centres = [int(np.argmax(self.reads))]
        p = np.ones(n)

        def meet(c: int, cutoff: float) -> None:
            nonlocal rates
            centre = centres[c]
            ok = ~(o.greedy & ((self.reads > self.reads[centre]) | lock))
            found = self.compare(centre, np.flatnonzero(ok), cutoff)
            keep = {}
            for i in range(n) if c == 0 else found:
                lam, ham = found[i][:2] if i in found else (0.0, -1)
                if c == 0 or lam * total > best_e[i]:
                    best_e[i] = max(best_e[i], lam * self.reads[centre])
                    keep[i] = (lam, ham)
            stored.append(keep)
            row = np.full((1, n), -1.0)
            row[0, list(keep)] = [v[0] for v in keep.values()]
            rates = np.concatenate([rates, row])

        def update() -> None:
            size = np.bincount(label, self.reads, len(centres))
            for i in range(n):
                c = int(label[i])
                lam, ham = stored[c].get(i, (0.0, -1))
                if self.reads[i] == 1 and not self.prior[i] and not o.detect_singletons or ham == 0 or i == centres[c]:
                    p[i] = 1.0
                else:
                    p[i] = abundance_p(int(self.reads[i]), lam * size[c], bool(self.prior[i]))
                if o.greedy and (i == centres[c] or self.reads[centres[c]] * lam > self.reads[i]):
                    lock[i] = True

        meet(0, 1.0)
        update()
        births = [{"birth_from": None, "birth_p": None, "birth_fold": None, "birth_ham": None}]
        while len(centres) < (o.max_clust or n):
            size = np.bincount(label, self.reads, len(centres))
            ham = np.array([stored[c].get(i, (0.0, -1))[1] for i, c in enumerate(label.tolist())])
            lam = np.array([stored[c].get(i, (0.0, -1))[0] for i, c in enumerate(label.tolist())])
            able = (self.reads >= o.min_abundance) & (ham >= o.min_hamming) & ((o.min_fold <= 1) | (self.reads >= o.min_fold * lam * size[label]))
            able[centres] = False
            pick = np.flatnonzero(able)
            if not len(pick):
                break
            pick = pick[np.lexsort((pick, label[pick], -self.reads[pick], p[pick]))]
            i, worth = int(pick[0]), n
            if not p[i] * n < o.omega_a:
                known = pick[self.prior[pick]]
                if not len(known) or not p[known[0]] < o.omega_p:
                    break
                i, worth = int(known[0]), 1
            mean = lam[i] * size[label[i]]
            births.append({"birth_from": int(label[i]), "birth_p": float(p[i]) * worth, "birth_fold": float(self.reads[i] / mean) if mean else np.inf, "birth_ham": int(ham[i])})
            label[i] = len(centres)
            centres.append(i)
            meet(len(centres) - 1, o.kdist_cutoff)
            for _ in range(MAX_SHUFFLE):
                size = np.bincount(label, self.reads, len(centres))
                new = (rates * size[:, None]).argmax(0)
                new[centres] = label[centres]
                if (new == label).all():
                    break
                label = new
            update()
        return self._finish(label, centres, births, rates)

    def born_of(self, parent: int, centre: int) -> list[tuple[int, str, str, int]]:
        """Substitutions of a centre against the one of the cluster it left: place there, both letters, quality."""
        a, b = self.seqs[parent], self.seqs[centre]
        x, y = (a, b) if self.o.band == 0 else align([(a, b)], self.o.match, self.o.mismatch, self.o.gap, self.o.band, run_gap=self.o.run_gap)[0]
        at = np.cumsum([q != "-" for q in y]) - 1
        return [(i, p, q, int(self.quals[centre][k])) for (i, p, q), k in zip(substitutions(x, y), [at[j] for j, (p, q) in enumerate(zip(x, y, strict=True)) if p != q and "-" not in (p, q)], strict=True)]

    def _finish(self, label: np.ndarray, centres: list[int], births: list, rates: np.ndarray) -> dict:
        size = np.bincount(label, self.reads, len(centres))
        n, width = len(self.seqs), self.err.shape[1]
        pval, right, ham = np.ones(n), np.ones(n, bool), np.zeros(n, np.int64)
        trans = np.zeros((16, width), np.int64)
        for c, centre in enumerate(centres):
            members = np.flatnonzero(label == c)
            free = Sample.compare(self, centre, members, 2.0)
            for i in members.tolist():
                lam, ham[i], change = free[i]
                if i != centre:
                    pval[i] = abundance_p(int(self.reads[i]), lam * size[c], True)
                right[i] = pval[i] >= self.o.omega_c
                if right[i]:
                    np.add.at(trans, (change, self.quals[i]), self.reads[i])
        rows, subs = [], []
        others = np.where(rates[:, centres] > 0, rates[:, centres], 0) * size[:, None]  # reads expected of each cluster at each centre
        np.fill_diagonal(others, 0)
        for c, centre in enumerate(centres):
            made = self.born_of(centres[births[c]["birth_from"]], centre) if c else []
            subs += [{"cluster": c, "pos": i, "from_nt": a, "to_nt": b, "q": q} for i, a, b, q in made]
            own = (label == c) & right
            weight = lambda mask: int(self.reads[mask].sum())
            rows.append({"cluster": c, "seq": self.seqs[centre], "abundance": weight(own), "n0": weight(own & (ham == 0)), "n1": weight(own & (ham == 1)), "nunq": int(own.sum()), "pval": abundance_p(int(self.reads[centre]), float(others[:, c].sum()), True), **births[c], "birth_q": float(np.mean([m[3] for m in made])) if made and self.o.use_quals else None})
        return {"clusters": rows, "births": subs, "map": np.where(right, label, -1), "p": pval, "trans": trans}
