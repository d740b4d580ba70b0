"""Gradient-boosted trees on binned features and isotonic calibration, in arrays.

Fitted on the driver on a bounded sample; applied by the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class BoostedTrees:
    """Log-loss boosting; each tree is complete, of `depth` levels, on quantile bins."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    leaf_weight: float = 1.0
    ridge: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).astype(np.int64) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, d = x.shape
        weight = np.ones(n) if weight is None else weight
        mean = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
        self.base = float(np.log(mean / (1 - mean)))
        self.trees = []
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
        if n == 0 or y.min() == y.max():
            return self
        b, width = self._binned(x), self.bins + 1
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            p = logistic(margin)
            grad, hess = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, width, np.int64)
            for level in range(self.depth):
                first, k = (1 << level) - 1, 1 << level
                best, gain = [(0, width)] * k, np.full(k, 1e-6)
                for j in range(d):
                    at = node * width + b[:, j]
                    g = np.bincount(at, grad, k * width).reshape(k, width).cumsum(1)
                    h = np.bincount(at, hess, k * width).reshape(k, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    score = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                    score[(h < self.leaf_weight) | (ht - h < self.leaf_weight)] = 0
                    top = score.argmax(1)
                    for i in np.flatnonzero(score[np.arange(k), top] > gain):
                        gain[i], best[i] = score[i, top[i]], (j, int(top[i]) + 1)
                for i, (j, c) in enumerate(best):
                    feature[first + i], cut[first + i] = j, c
                node = 2 * node + (b[np.arange(n), feature[first + node]] >= cut[first + node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
            margin += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (b[rows, feature[at]] >= cut[at])
            out += value[node]
        return out


@dataclass
class Isotonic:
    """Pool-adjacent-violators; between the pooled blocks the value is interpolated."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, score: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        weight = np.ones(len(score)) if weight is None else weight
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
        for s, t, w in zip(score[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([w * t, w, w * s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        # half a case of the other side keeps a pure block off 0 and 1
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.maximum.accumulate(np.array([(b[0] + 0.5 * (b[0] == 0)) / (b[1] + 0.5 * (b[0] in (0, b[1]))) for b in blocks])) if blocks else np.zeros(0)
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else logistic(score)


@dataclass
class Calibrated:
    """Trees on all rows; the calibration comes from margins of rows that the trees did not see."""

    trees: BoostedTrees
    curve: Isotonic

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = 4, weight: np.ndarray | None = None, **options) -> Calibrated:
        weight = np.ones(len(y)) if weight is None else weight
        unseen = np.zeros(len(y))
        for k in range(folds):
            out = fold % folds == k
            if out.any():
                unseen[out] = BoostedTrees(**options).fit(x[~out], y[~out], weight[~out]).margin(x[out])
        return cls(BoostedTrees(**options).fit(x, y, weight), Isotonic().fit(unseen, y, weight))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.curve.apply(self.trees.margin(x))
