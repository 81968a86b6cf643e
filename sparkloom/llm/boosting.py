"""Gradient-boosted trees and isotonic calibration in numpy, for feature tables of bounded size."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary log-loss boosting over quantile bins; plain arrays, so it pickles small."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty = trees, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.empty(0)] * x.shape[1]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.start, self.model = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(y), self.start)
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.model.append(tree)
            raw += self._apply(tree, binned)
        return self

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes in heap order: (feature, last bin of the left side, value); feature -1 is a leaf."""
        nodes: list[tuple] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        at = {0: np.arange(len(g))}
        for k in range(len(nodes)):
            if k not in at:
                continue
            rows = at.pop(k)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[k] = (-1, 0, self.rate * gs / (hs + self.penalty))
            if 2 * k + 2 >= len(nodes) or len(rows) < 10:
                continue
            best = (1e-6, -1, 0)
            for j in range(binned.shape[1]):
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], self.bins))
                hl = np.cumsum(np.bincount(b, h[rows], self.bins))
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                # Of gains equal but for rounding the first one, so that the order of sums decides nothing.
                s = int(np.argmax(gain > gain.max() - 1e-9))
                if gain[s] > best[0] + 1e-9:
                    best = (float(gain[s]), j, s)
            if best[1] >= 0:
                nodes[k] = best[1:] + (0.0,)
                left = binned[rows, best[1]] <= best[2]
                at[2 * k + 1], at[2 * k + 2] = rows[left], rows[~left]
        return nodes

    def _apply(self, tree: list[tuple], binned: np.ndarray) -> np.ndarray:
        feature, split, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(binned), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[at]
            right = binned[np.arange(len(binned)), np.maximum(f, 0)] > split[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return value[at].astype(float)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)
        return self.start + sum((self._apply(t, binned) for t in self.model), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising knots (raw score, share of ones), smoothed towards 0.5 by half a row."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of raw, sum of y, rows
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(r), float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    xs = np.array([b[0] / b[2] for b in blocks])
    return xs, np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))
