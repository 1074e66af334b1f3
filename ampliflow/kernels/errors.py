"""Error models: 16 x Q matrices of transition counts in, rates out (rows 4 * from + to in A, C, G, T order)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAST, MOST = 1e-7, 0.25


def _local(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: float, near: int) -> tuple[float, float]:
    """Value and slope at a point of the tricube-weighted parabola through its nearest points."""
    d = (x - at) ** 2
    some = np.argsort(d, kind="stable")[:near]
    reach = d[some[-1]]
    u = np.sqrt(d[some] / reach) if reach > 0 else np.ones(near)
    weight = np.sqrt(w[some] * np.where(u < 1, (1 - u**3) ** 3, 0))
    if reach <= 0 or not weight.any():
        return float(y[some[0]]), 0.0
    design = np.vander(x[some] - at, 3, increasing=True) * weight[:, None]
    norm = np.linalg.norm(design, axis=0)
    norm[norm == 0] = 1
    beta = np.linalg.lstsq(design / norm, y[some] * weight, rcond=100 * np.finfo(float).eps)[0] / norm
    return float(beta[0]), float(beta[1])


def loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Local quadratic regression, exact at the vertices of halved cells and cubic between them; nan outside the data."""
    n = len(x)
    near, small = max(1, min(n, int(n * span + 1e-5))), max(1, int(n * span * 0.2))
    margin = 0.005 * max(x[-1] - x[0], 1e-10 * max(abs(x[0]), abs(x[-1])) + 1e-30)
    ends = (x[0] - margin, x[-1] + margin)
    vertex, cells = set(ends), [(0, n - 1, *ends)]
    while cells:
        lo, hi, a, b = cells.pop()
        cut = x[(lo + hi) // 2]
        if hi - lo + 1 > small and cut not in (a, b):
            vertex.add(cut)
            cells += [(lo, (lo + hi) // 2, a, cut), ((lo + hi) // 2 + 1, hi, cut, b)]
    v = np.array(sorted(vertex))
    value, slope = np.array([_local(x, y, w, c, near) for c in v]).T
    k = np.clip(np.searchsorted(v, at, "left"), 1, len(v) - 1)
    width = v[k] - v[k - 1]
    h = (at - v[k - 1]) / width
    out = (1 - h) ** 2 * (1 + 2 * h) * value[k - 1] + h**2 * (3 - 2 * h) * value[k] + (h * (1 - h) ** 2 * slope[k - 1] + h**2 * (h - 1) * slope[k]) * width
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def _complete(rate: Callable[[int, int, np.ndarray, np.ndarray], np.ndarray], trans: np.ndarray) -> np.ndarray:
    """Rates of all changes from counts and totals of the base; what is left is no change."""
    t = np.asarray(trans, float).reshape(4, 4, -1)
    total = t.sum(1)
    out = np.zeros_like(t)
    for i in range(4):
        for j in range(4):
            if i != j:
                out[i, j] = np.clip(rate(i, j, t[i, j], total[i]), LEAST, MOST)
        out[i, i] = 1 - out[i].sum(0)
    return out.reshape(16, -1)


def loess_errors(trans: np.ndarray) -> np.ndarray:
    """Smoothed log10 rates over quality, flat beyond the observed qualities."""

    def rate(_i: int, _j: int, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        seen = np.flatnonzero(total > 0)
        if len(seen) < 2:
            return np.full(len(n), LEAST)
        q = np.arange(len(n), dtype=float)
        fit = loess(q[seen], np.log10((n[seen] + 1) / total[seen]), np.maximum(total[seen], 1), q)
        fit[: seen[0]], fit[seen[-1] + 1 :] = fit[seen[0]], fit[seen[-1]]
        return 10**fit

    return _complete(rate, trans)


def pacbio_errors(trans: np.ndarray) -> np.ndarray:
    """As ``loess_errors``, with quality 93 estimated on its own where it is present."""
    trans = np.asarray(trans)
    if trans.shape[1] <= 93:
        return loess_errors(trans)
    out = np.insert(loess_errors(np.delete(trans, 93, 1)), 93, 0.0, 1)
    t = trans[:, 93].reshape(4, 4)
    own = (t + 1) / (t.sum(1, keepdims=True) + 4)
    np.fill_diagonal(own, 0)
    np.fill_diagonal(own, 1 - own.sum(1))
    out[:, 93] = own.ravel()
    return out


def binned_errors(bins: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    """An error model that interpolates observed rates between the given qualities."""

    def model(trans: np.ndarray) -> np.ndarray:
        def rate(_i: int, _j: int, n: np.ndarray, total: np.ndarray) -> np.ndarray:
            seen = np.divide(n, total, out=np.zeros_like(n), where=total > 0)
            at = [int(round(b)) for b in bins if 0 <= round(b) < len(n)]
            return np.interp(np.arange(len(n)), at, seen[at]) if len(at) > 1 else seen

        return _complete(rate, trans)

    return model


def flat_errors(trans: np.ndarray) -> np.ndarray:
    """Rates that do not depend on quality; 1/4 for a base never seen."""
    t = np.asarray(trans, float).reshape(4, 4, -1)
    rate = t.sum(2)
    total = rate.sum(1, keepdims=True)
    rate = np.divide(rate, total, out=np.full_like(rate, 0.25), where=total > 0)
    return np.repeat(rate.reshape(16, 1), t.shape[2], 1)


def initial_errors(width: int = 41) -> np.ndarray:
    return np.ones((16, width))
