"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2.

    A row goes right where its value is greater than the threshold, so a missing
    value (NaN) goes left.  A node that wasn't split sends all rows left.
    """

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row, all rows and trees in step."""
        out = np.full(len(x), self.base)
        inner, n_trees = self.feature.shape[1], len(self.feature)
        if not n_trees:
            return 1 / (1 + np.exp(-out))
        flat_f, flat_t, flat_l = self.feature.ravel(), self.threshold.ravel(), self.leaf.ravel()
        roots = np.arange(n_trees) * inner
        leaves = np.arange(n_trees) * (inner + 1) - inner
        for lo in range(0, len(x), 4096):
            part = np.ascontiguousarray(x[lo : lo + 4096], dtype=np.float32)
            rows = (np.arange(len(part)) * part.shape[1])[:, None]
            at = np.zeros((len(part), n_trees), dtype=np.int64)
            values = part.ravel()
            for _ in range(int(np.log2(inner + 1))):
                node = roots + at
                at = 2 * at + 1 + (values[rows + flat_f[node]] > flat_t[node])
            out[lo : lo + 4096] += flat_l[leaves + at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, least: int = 20, l2: float = 1.0) -> Trees:
    """Boosting of the logistic loss. One class, or no rows, gives a constant."""
    x, y = np.asarray(x, dtype=np.float32), np.asarray(y, dtype=np.float64)
    n, d = x.shape
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.nanquantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) if np.isfinite(x[:, j]).any() else np.zeros(0, np.float32) for j in range(d)]
    binned = np.stack([np.searchsorted(c, np.where(np.isnan(v), -np.inf, v), side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    width = bins + 1
    cell = binned + np.arange(d) * width
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf, np.float32), np.zeros((n_trees, inner + 1))
    f = np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (d * width) + cell).ravel()
            size = nodes * d * width
            hist = [np.bincount(key, np.repeat(v, d), minlength=size).reshape(nodes, d, width).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -np.inf
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), width)
                if gain[k, j, b] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            node_f, node_t = feature[t][at], threshold[t][at]
            at = 2 * at + 1 + (x[np.arange(n), node_f] > node_t)
        at -= inner
        value = -rate * np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + l2)
        leaf[t] = value
        f += value[at]
    return Trees(feature, threshold, leaf, base)
