"""Gradient-boosted trees for classes, with binned features, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete trees of one depth in heap order, class by class within each round."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: np.ndarray

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """log P(class) of each row."""
        classes = len(self.base)
        out = np.tile(self.base, (len(x), 1))
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, self.feature[t][at]] > self.threshold[t][at])
            out[:, t % classes] += self.value[t][at - inner]
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int = 3, rounds: int = 30, depth: int = 4, rate: float = 0.25, bins: int = 16, ridge: float = 2.0) -> Trees:
    """Trees for rows x (float32) of classes y: each round fits one tree a class to the gradient of the log loss."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(f)]
    codes = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.int64)
    edges = np.stack([np.concatenate([e, np.full(bins - len(e), np.inf)]) for e in edges]).astype(np.float32)
    cell = codes + np.arange(f) * bins
    base = np.log(np.bincount(y, minlength=classes) + 1.0) - np.log(n + classes)
    scores = np.tile(base, (n, 1))
    inner = 2**depth - 1
    feature, threshold, value = [], [], []
    rows = np.arange(n)
    for _ in range(rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(classes):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
            feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                where = (cell + ((at - first) * (f * bins))[:, None]).ravel()
                sums = [np.bincount(where, np.repeat(v, f), width * f * bins).reshape(width, f, bins) for v in (g, h)]
                left_g, left_h = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=2, keepdims=True) for s in sums)
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                best = gain.reshape(width, -1).argmax(axis=1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                feat[first : first + width] = np.where(good, best // (bins - 1), 0)
                thr[first : first + width] = np.where(good, edges[best // (bins - 1), best % (bins - 1)], np.inf)
                at = 2 * at + 1 + (x[rows, feat[at]] > thr[at])
            leaf = at - inner
            value_c = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            scores[:, c] += value_c[leaf]
            feature.append(feat)
            threshold.append(thr)
            value.append(value_c)
    return Trees(np.stack(feature), np.stack(threshold), np.stack(value), base)
