"""Gradient-boosted trees on histograms, in numpy: small models that are trained where they are used."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A binary tree as arrays; children of i are 2i+1 (value <= threshold) and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row. A leaf above the last level is passed on to its left, where its value is looked up again."""
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.maximum(self.feature, 0), np.where(self.feature >= 0, self.threshold, np.inf)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            at = 2 * at + 1 + (flat.take(row + feature.take(at)) > threshold.take(at))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        value = self.value.copy()
        for i in np.flatnonzero(self.feature < 0):
            if 2 * i + 1 < len(value):
                value[2 * i + 1] = value[i]
        return value[self.leaves(x)]


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    out = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float, least: float) -> Tree:
    n_nodes, n_features, bins = 2 ** (depth + 1) - 1, codes.shape[1], max(2, max(map(len, edges)) + 1)
    tree = Tree(np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes))
    at = np.zeros(len(g), np.int64)
    column = np.arange(n_features) * bins
    alive = np.ones(len(g), bool)
    for level in range(depth + 1):
        base, width = 2**level - 1, 2**level
        gs = np.bincount(at[alive] - base, g[alive], width)
        hs = np.bincount(at[alive] - base, h[alive], width)
        tree.value[base : base + width] = -rate * gs / (hs + l2)
        if level == depth:
            break
        key = ((at[alive] - base)[:, None] * (n_features * bins) + column + codes[alive]).ravel()
        size = width * n_features * bins
        gl = np.bincount(key, np.repeat(g[alive], n_features), size).reshape(width, n_features, bins).cumsum(2)[:, :, :-1]
        hl = np.bincount(key, np.repeat(h[alive], n_features), size).reshape(width, n_features, bins).cumsum(2)[:, :, :-1]
        gr, hr = gs[:, None, None] - gl, hs[:, None, None] - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -np.inf) - (gs**2 / (hs + l2))[:, None, None]
        best = gain.reshape(width, -1).argmax(1)
        for j in range(width):
            f, b = divmod(int(best[j]), bins - 1)
            if hs[j] > 0 and gain[j, f, b] > 1e-6 and b < len(edges[f]):
                tree.feature[base + j], tree.threshold[base + j] = f, edges[f][b]
        f = tree.feature[at]
        alive &= f >= 0
        rows = np.flatnonzero(alive)
        fr = f[rows]
        split = np.array([np.searchsorted(edges[k], t) if k >= 0 else 0 for k, t in zip(tree.feature.tolist(), tree.threshold.tolist(), strict=True)])
        at[rows] = 2 * at[rows] + 1 + (codes[rows, fr] > split[at[rows]])
    return tree


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None, share: float = 1.0, seed: int = 0) -> tuple[float, list[Tree]]:
    """A base log-odds and trees for 0/1 labels. `share` is the part of rows and of features that a tree sees."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(y)) if weight is None else weight
    mean = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    edges = _edges(x, bins)
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < share) if share < 1 else np.arange(len(y))
        columns = np.flatnonzero(rng.random(len(edges)) < share) if share < 1 else np.arange(len(edges))
        if not len(rows) or not len(columns):
            continue
        tree = _grow(codes[np.ix_(rows, columns)], [edges[f] for f in columns], g[rows], h[rows], depth, rate, l2, least)
        tree.feature = np.where(tree.feature >= 0, columns[np.maximum(tree.feature, 0)], -1)
        score = score + tree.predict(x)
        out.append(tree)
    return base, out


def predict(base: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    score = np.full(len(x), base)
    for t in trees:
        score += t.predict(x)
    return 1 / (1 + np.exp(-score))
