"""Gradient-boosted trees on binned dense features, and isotonic calibration; small, deterministic, NumPy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees in heap layout."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # Sparse densities are mostly 0: half the smallest positive value always parts zero from non-zero.
        self.edges = [np.unique(np.concatenate([e, [c[c > 0].min() / 2]])) if (c > 0).any() else e for e, c in zip(self.edges, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 0.5
        self.base, self.model = float(np.log(mean / (1 - mean))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(binned, p - y, p * (1 - p))
            self.model.append(tree)
            raw += self.rate * self._walk(tree, binned)
        return self

    def _tree(self, binned, g, h):
        inner = 2**self.depth - 1
        feature, cut, leaf = np.zeros(inner, dtype=int), np.full(inner, 10**6), np.zeros(inner + 1)
        node = np.zeros(len(g), dtype=int)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for f in range(binned.shape[1]):
                width = len(self.edges[f]) + 1
                at = (node - first) * width + binned[:, f]
                gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                where = gain.argmax(axis=1)
                value = gain[np.arange(count), where]
                better = value > best + 1e-12
                best[better] = value[better]
                feature[first : first + count][better] = f
                cut[first : first + count][better] = where[better]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[:] = -gs / (hs + self.ridge)
        return feature, cut, leaf

    def _walk(self, tree, binned):
        feature, cut, leaf = tree
        node, rows = np.zeros(len(binned), dtype=int), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        return self.base + self.rate * sum((self._walk(t, binned) for t in self.model), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray):
    """Pool adjacent violators: (knots, values) of the non-decreasing fit.

    Each pool counts one more row, of the mean label, so that no score is calibrated to 0 or 1; a running maximum keeps the order.
    """
    order = np.argsort(raw, kind="stable")
    xs, ys = raw[order], y[order]
    edges, start = np.unique(xs, return_index=True)  # equal raw scores form one pool from the start
    pools = []
    for k, (e, total, n) in enumerate(zip(edges, np.add.reduceat(ys, start) if len(ys) else [], np.diff([*start, len(ys)]), strict=True)):
        pools.append([total, n, e])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, n, e = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + n, e]
    mean = float(y.mean()) if len(y) else 0.5
    return np.array([p[2] for p in pools]), np.maximum.accumulate(np.array([(p[0] + mean) / (p[1] + 1) for p in pools])) if pools else np.array([])


def calibrated(raw: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Linear between the upper ends of the pools, so that order within a pool is kept weakly."""
    return np.interp(raw, knots, values) if len(knots) else np.full(len(raw), 0.5)
