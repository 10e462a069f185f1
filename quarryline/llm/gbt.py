"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Full trees of one depth: at inner node i a row goes to 2 i + 1, or to 2 i + 2 where its feature's
    bin is above the border."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    border: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        flat, width = b.ravel(), b.shape[1]
        rows = np.arange(len(b)) * width
        out = np.full(len(b), self.base)
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.border, self.leaf, strict=True):
            at = np.zeros(len(b), np.int64)
            while True:
                at = 2 * at + 1 + (flat[rows + f[at]] > t[at])
                if not len(at) or at[0] >= inner:
                    break
            out += leaf[at - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Second-order boosting of the logistic loss; every split is the best over all features and borders.
    ``least``: the smallest sum of second derivatives in a child. The same input gives the same trees."""
    edges = []
    for column in x.T:  # all values where they are few, so that rare ones are seen
        values = np.unique(column)
        edges.append(values[1:] if len(values) <= bins else np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")))
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner, leaves = 2**depth - 1, 2**depth
    model = Boosted(edges, float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, leaves)))
    b = model.bins(x).astype(np.int64)
    score = np.full(len(y), model.base)
    features = x.shape[1]
    offset = np.arange(features) * bins
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * features * bins + offset + b).ravel()
            sums = [np.bincount(cell, weights=np.repeat(v, features), minlength=n * features * bins).reshape(n, features, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            some = gain.reshape(n, -1)[np.arange(n), best] > 1e-6
            model.feature[k, first : first + n] = np.where(some, best // bins, 0)
            model.border[k, first : first + n] = np.where(some, best % bins, 255)  # 255: all go left
            at = 2 * at + 1 + (b[np.arange(len(b)), model.feature[k, at]] > model.border[k, at])
        at -= inner
        total_g, total_h = (np.bincount(at, weights=v, minlength=leaves) for v in (g, h))
        model.leaf[k] = -rate * total_g / (total_h + ridge)
        score += model.leaf[k, at]
    return model
