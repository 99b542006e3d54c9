"""Gradient-boosted trees on logistic loss, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth as arrays (trees x nodes): node i has children 2i+1 and 2i+2; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = f[node]
                go = x[rows, np.maximum(at, 0)] > t[node]
                node = np.where(at >= 0, 2 * node + 1 + go, node)
            out += v[node]
        return out


def _best_split(grad, hess, counts, mono, low, high, least_rows):
    """(gain, feature, bin) of a node from its histograms (features x bins), or None."""
    gl, hl, nl = grad.cumsum(1)[:, :-1], hess.cumsum(1)[:, :-1], counts.cumsum(1)[:, :-1]
    g, h, n = grad.sum(1)[:, None], hess.sum(1)[:, None], counts.sum(1)[:, None]
    lam = 1.0
    left, right = np.clip(-gl / (hl + lam), low, high), np.clip(-(g - gl) / (h - hl + lam), low, high)
    loss = lambda v, g, h: g * v + 0.5 * (h + lam) * v * v
    whole = np.clip(-g / (h + lam), low, high)
    gain = loss(whole, g, h) - loss(left, gl, hl) - loss(right, g - gl, h - hl)
    ok = (nl >= least_rows) & (n - nl >= least_rows) & ((right - left) * mono[:, None] >= 0)
    gain = np.where(ok, gain, -np.inf)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    return (gain[at], at[0], at[1], left[at], right[at]) if gain[at] > 1e-6 else None


def train(x: np.ndarray, y: np.ndarray, mono: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least_rows: int = 20) -> Forest:
    """Fits on rows x and labels y (0 or 1). mono holds 1, -1 or 0 for each feature: how the score may go with it."""
    n, width, nodes = len(x), x.shape[1], 2 ** (depth + 1) - 1
    forest = Forest(np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes)), 0.0, depth)
    if n == 0 or y.min() == y.max():
        forest.bias = 20.0 if n == 0 or y[0] else -20.0
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p = y.mean()
    forest.bias = float(np.log(p / (1 - p)))
    score = np.full(n, forest.bias)
    flat = binned + np.arange(width) * bins
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for at in range(2**depth - 1):
            if at not in bounds:
                continue
            rows = np.flatnonzero(node == at)
            low, high = bounds[at]
            if len(rows) == 0:
                continue
            hist = [np.bincount(flat[rows].ravel(), np.repeat(w[rows], width), width * bins).reshape(width, bins) for w in (grad, hess, np.ones(n))]
            if at == 0:
                forest.value[t, 0] = -grad.sum() / (hess.sum() + 1)
            best = _best_split(*hist, mono, low, high, least_rows)
            if best is None:
                continue
            _, j, b, left, right = best
            if b >= len(edges[j]):
                continue
            forest.feature[t, at], forest.threshold[t, at] = j, edges[j][b]
            forest.value[t, 2 * at + 1], forest.value[t, 2 * at + 2] = left, right
            middle = (left + right) / 2
            bounds[2 * at + 1] = (low, middle) if mono[j] > 0 else (middle, high) if mono[j] < 0 else (low, high)
            bounds[2 * at + 2] = (middle, high) if mono[j] > 0 else (low, middle) if mono[j] < 0 else (low, high)
            node[rows] = 2 * at + 1 + (binned[rows, j] > b)
        forest.value[t] *= rate
        score += forest.value[t, node]
    return forest
