"""Gradient-boosted trees with logistic loss over binned features, in numpy: small enough to be fitted on the driver and broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees of equal depth: for node k the children are 2k+1 and 2k+2; leaves hold the raised log odds."""

    edges: list[np.ndarray]
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): go right if the bin is over it
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        binned = bins_of(x, self.edges)
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, least: float = 5.0, part: float = 1.0) -> Boosted:
    """Newton boosting: every split is the one of the largest gain over the histogram of gradients of its node. Each tree is grown on another ``part`` of the rows."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = bins_of(x, edges)
    n, width = x.shape
    offsets = np.arange(width) * bins
    rng = np.random.default_rng(11)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    odds = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, leaves))
    for t in range(trees):
        rows = np.arange(n) if part >= 1 else np.sort(rng.choice(n, max(1, int(n * part)), replace=False))
        mine, flat = binned[rows], binned[rows].astype(np.int64) + offsets
        p = 1 / (1 + np.exp(-odds[rows]))
        g, h = y[rows] - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = (node - first)[:, None] * (width * bins) + flat
            size = many * width * bins
            sums = [np.bincount(at.ravel(), np.repeat(w, width), size).reshape(many, width, bins) for w in (g, h)]
            left = [np.cumsum(s, axis=2) for s in sums]
            total = [x[:, :, -1:] for x in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[1] < least / 4) | (total[1] - left[1] < least / 4)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            good = gain.reshape(many, -1).max(axis=1) > 1e-6
            features[t, first : first + many] = best // bins
            cuts[t, first : first + many] = np.where(good, best % bins, 255)
            node = 2 * node + 1 + (mine[np.arange(len(rows)), features[t][node]] > cuts[t][node])
        slot = node - inner
        values[t] = rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + ridge)
        node = np.zeros(n, np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (binned[np.arange(n), features[t][node]] > cuts[t][node])
        odds += values[t][node - inner]
    return Boosted(edges, features, cuts, values, base)
