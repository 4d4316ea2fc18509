"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most ``bins`` quantile bins; trees of a fixed depth grow level by level from histograms of
gradients. A fitted model is flat: for each tree a complete binary tree in an array, so that scoring is ``depth``
rounds of array lookups for all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray
    value: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        depth = self.value.shape[1].bit_length() - 1 if self.value.size else 0
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        leaves = self.value[trees, at - (self.value.shape[1] - 1)] if self.value.size else np.zeros((len(x), 0))
        return 1 / (1 + np.exp(-(self.base + leaves.sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Trees for ``y`` in {0, 1}. With no rows or one class, no trees: the score is the smoothed share of class 1."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner = (1 << depth) - 1
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 1 << depth)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    flat = binned + np.arange(f) * bins
    margin = np.full(n, base)
    feature, threshold, value = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        tf, tt = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            cell = ((node - first)[:, None] * (f * bins) + flat).ravel()
            sums = [np.bincount(cell, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    tf[first + k], tt[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), tf[node]] > tt[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + l2)
        margin += v[leaf]
        feature.append(tf), threshold.append(tt), value.append(v)
    return Trees(base, np.array(feature), np.array(threshold), np.array(value))
