"""Gradient-boosted trees on a bounded sample, flattened into node arrays; isotonic calibration.

Fitting sees at most the documented number of sampled rows and runs on the driver in numpy; scoring
is vectorised over any number of rows and runs wherever the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node i's children are 2i+1 (not above its threshold) and 2i+2."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, trees: int = 80, depth: int = 4,
        rate: float = 0.15, bins: int = 48, least: int = 10, ridge: float = 1.0) -> Trees:
    """Logistic loss, Newton leaves. ``monotone``: for each feature 1 (the score may only rise with it),
    -1 (only fall) or 0; bounds handed down the tree keep whole subtrees on their side."""
    n, m = x.shape
    monotone = np.array(monotone or [0] * m)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, m), int)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    raw = np.full(n, base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * leaves, -np.inf), np.full(2 * leaves, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            at = node - first
            best_gain = np.full(width, 1e-7)
            best = [None] * width
            total_g, total_h = np.bincount(at, grad, width), np.bincount(at, hess, width)
            for j in range(m):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                slot = at * k + code[:, j]
                g = np.cumsum(np.bincount(slot, grad, width * k).reshape(width, k), 1)[:, :-1]
                h = np.cumsum(np.bincount(slot, hess, width * k).reshape(width, k), 1)[:, :-1]
                c = np.cumsum(np.bincount(slot, minlength=width * k).reshape(width, k), 1)
                gr, hr = total_g[:, None] - g, total_h[:, None] - h
                gain = g * g / (h + ridge) + gr * gr / (hr + ridge) - (total_g ** 2 / (total_h + ridge))[:, None]
                ok = (c[:, :-1] >= least) & (c[:, -1:] - c[:, :-1] >= least)
                if monotone[j]:
                    ok &= monotone[j] * (gr / (hr + ridge) - g / (h + ridge)) >= 0
                gain = np.where(ok, gain, -np.inf)
                pick = gain.argmax(1)
                for w in np.flatnonzero(gain[np.arange(width), pick] > best_gain):
                    b = pick[w]
                    best_gain[w] = gain[w, b]
                    best[w] = (j, b, g[w, b] / (h[w, b] + ridge), gr[w, b] / (hr[w, b] + ridge))
            for w in range(width):
                i = first + w
                lc, rc = 2 * i + 1, 2 * i + 2
                low[[lc, rc]], high[[lc, rc]] = low[i], high[i]
                if best[w] is not None:
                    j, b, left, right = best[w]
                    feature[t, i], threshold[t, i] = j, edges[j][b]
                    if monotone[j]:
                        middle = np.clip((left + right) / 2, low[i], high[i])
                        lower, upper = (lc, rc) if monotone[j] > 0 else (rc, lc)
                        high[lower], low[upper] = middle, middle
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        value = np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        leaf[t] = rate * np.clip(value, low[inner:inner + leaves], high[inner:inner + leaves])
        raw += leaf[t][at]
    return Trees(feature, threshold, leaf, base, depth)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, probability) points of the rising step function nearest to the labels (pool adjacent
    violators); read between them with np.interp. Without rows: the identity."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    at, first = np.unique(score[order], return_index=True)
    blocks: list[list[float]] = []  # weight, mean, number of points
    for s, c in zip(np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(order))), strict=True):
        blocks.append([float(c), s / c, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, v, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, (blocks[-1][0] * blocks[-1][1] + w * v) / (blocks[-1][0] + w), blocks[-1][2] + k]
    return at, np.concatenate([np.full(int(k), v) for _, v, k in blocks])
