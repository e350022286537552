"""Recursive graph bisection: an order of documents in which those that share terms lie near each other.

A set of documents is halved so that the terms' occurrences split as unevenly as they can (Dhulipala et al., 2016): the
cost of a half is what log-gaps of its posting lists take, and documents swap sides in pairs as long as a swap lowers it.
Halves are halved again. The splits are found on a bounded sample; each keeps a weight for every term bucket and the
median of its own documents, so that any document can be sent down the tree on its own.
"""

from __future__ import annotations

from typing import NamedTuple
from zlib import crc32

import numpy as np

#: Term buckets of the splits, swaps tried at each split, documents of the sample that a leaf should have at least.
BUCKETS, ROUNDS, LEAF = 1 << 15, 8, 48


class Tree(NamedTuple):
    """Splits in heap order: weights (splits x BUCKETS, float16), thresholds, and the depth; 2 ** depth leaves. At most 4.2 MB."""

    weights: np.ndarray
    thresholds: np.ndarray
    depth: int

    def leaf(self, terms: np.ndarray) -> tuple[int, float]:
        """The leaf of a document of these term buckets, and its mean weight at the last split."""
        at, mean = 0, 0.0
        for _ in range(self.depth):
            mean = float(self.weights[at, terms].mean(dtype=np.float32)) if len(terms) else 0.0
            at = 2 * at + (1 if mean > self.thresholds[at] else 2)
        return at - (2**self.depth - 1), mean


def bucket(term: str) -> int:
    return crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def fit(docs: list[np.ndarray], deepest: int = 6) -> Tree:
    """The tree of these documents, each given by its distinct term buckets."""
    docs = [d for d in docs if len(d)]
    depth = max(0, min(deepest, int(np.log2(max(1, len(docs) / LEAF)))))
    weights, thresholds = np.zeros((2**depth - 1, BUCKETS), np.float16), np.zeros(2**depth - 1)
    held = {0: np.arange(len(docs))}
    for at in range(2**depth - 1):
        own = held.pop(at)
        sizes = np.array([len(docs[i]) for i in own])
        terms, rows = np.concatenate([docs[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
        # to start with, documents that share their smallest bucket stand together
        left = np.zeros(len(own), bool)
        left[np.argsort([docs[i].min() for i in own], kind="stable")[: len(own) // 2]] = True
        for _ in range(ROUNDS):
            if not _swap(left, terms, rows):
                break
        n_left, n_right = left.sum(), (~left).sum()
        in_left = np.bincount(terms[left[rows]], minlength=BUCKETS)
        in_right = np.bincount(terms[~left[rows]], minlength=BUCKETS)
        weights[at] = np.log2((in_left + 1) / (n_left + 2)) - np.log2((in_right + 1) / (n_right + 2))
        mean = np.bincount(rows, weights[at].astype(np.float32)[terms], len(own)) / sizes
        thresholds[at] = np.median(mean)
        held[2 * at + 1], held[2 * at + 2] = own[mean > thresholds[at]], own[mean <= thresholds[at]]
        for child in (2 * at + 1, 2 * at + 2):
            if not len(held[child]):  # all alike: both sides go on with them
                held[child] = own
    return Tree(weights, thresholds, depth)


def _swap(left: np.ndarray, terms: np.ndarray, rows: np.ndarray) -> int:
    """Swap documents in pairs, those that gain most first, while a pair gains; the number of pairs."""
    side = left[rows]
    d = np.stack([np.bincount(terms[side], minlength=BUCKETS), np.bincount(terms[~side], minlength=BUCKETS)]).astype(float)
    n = np.array([[left.sum()], [(~left).sum()]], float)

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * np.log2(n[0] / (a + 1)) + b * np.log2(n[1] / (b + 1))

    now = cost(d[0], d[1])
    gain = np.where(side, (now - cost(np.maximum(d[0] - 1, 0), d[1] + 1))[terms], (now - cost(d[0] + 1, np.maximum(d[1] - 1, 0)))[terms])
    gain = np.bincount(rows, gain, len(left))
    out, into = np.flatnonzero(left), np.flatnonzero(~left)
    out, into = out[np.argsort(-gain[out], kind="stable")], into[np.argsort(-gain[into], kind="stable")]
    k = min(len(out), len(into))
    pairs = int(np.searchsorted(-(gain[out[:k]] + gain[into[:k]]), 0))
    left[out[:pairs]], left[into[:pairs]] = False, True
    return pairs
