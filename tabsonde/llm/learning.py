"""Small models fitted on bounded samples: logistic regression, isotonic steps, boosted trees.

Only their fitting runs on the driver; features are made and scores are computed in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def logit(p: np.ndarray, margin: float = 1e-6) -> np.ndarray:
    p = np.clip(p, margin, 1 - margin)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    ridge: float = 1.0
    steps: int = 25
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _columns(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, np.ones(len(z))])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(self.scale > 1e-12, self.scale, 1.0)
        z = self._columns(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            slope = z.T @ (p - y) + penalty * w
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(curve, slope)
            w -= move
            if np.abs(move).max() < 1e-8:
                break
        self.weights = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._columns(x) @ self.weights


@dataclass
class Isotonic:
    """Non-decreasing steps through (score, label), by pooling neighbours that fall."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        levels, first = np.unique(score[order], return_index=True)
        sums = np.add.reduceat(y[order].astype(float), first)
        sizes = np.diff(np.append(first, len(order))).astype(float)
        blocks: list[list[float]] = []  # lower edge, sum, size
        for edge, total, size in zip(levels, sums, sizes, strict=True):
            blocks.append([edge, total, size])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                _, total, size = blocks.pop()
                blocks[-1][1] += total
                blocks[-1][2] += size
        self.edges = np.array([b[0] for b in blocks])
        # A half row of either label keeps the ends off 0 and 1.
        self.values = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
        self.values = np.maximum.accumulate(self.values)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.edges, self.values)


@dataclass
class BoostedTrees:
    """Gradient-boosted trees of fixed depth for a yes/no label, on histograms.

    Every tree is a complete one: ``feature`` and ``cut`` by inner node, ``leaf`` by leaf.
    """

    trees: int = 80
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    leaf_weight: float = 1.0
    start: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, columns = x.shape
        cuts = [
            np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1]))
            for f in range(columns)
        ]
        binned = np.stack(
            [np.searchsorted(cuts[f], x[:, f], side="left") for f in range(columns)]
        )
        rate = y.mean()
        self.start = float(logit(np.array([rate]), 1e-3)[0])
        margin = np.full(n, self.start)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), int)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = sigmoid(margin)
            slope, curve = y - p, p * (1 - p)
            node = np.zeros(n, int)
            for level in range(self.depth):
                width = 1 << level
                base = width - 1
                best = np.full(width, 1e-9)
                chosen = np.full((width, 2), -1)
                for f in range(columns):
                    size = len(cuts[f]) + 1
                    key = (node - base) * size + binned[f]
                    g = np.bincount(key, slope, width * size).reshape(width, size).cumsum(axis=1)
                    h = np.bincount(key, curve, width * size).reshape(width, size).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = (
                        g**2 / (h + self.leaf_weight)
                        + (all_g - g) ** 2 / (all_h - h + self.leaf_weight)
                        - all_g**2 / (all_h + self.leaf_weight)
                    )[:, :-1]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    chosen[better] = np.column_stack([np.full(width, f), at])[better]
                right = np.zeros(n, int)
                for k in range(width):
                    f, at = chosen[k]
                    if f >= 0:
                        self.feature[t, base + k], self.cut[t, base + k] = f, cuts[f][at]
                        here = node == base + k
                        right[here] = binned[f][here] > at
                node = 2 * node + 1 + right
            where = node - inner
            g = np.bincount(where, slope, inner + 1)
            h = np.bincount(where, curve, inner + 1)
            self.leaf[t] = self.rate * g / (h + self.leaf_weight)
            margin += self.leaf[t][where]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        inner = (1 << self.depth) - 1
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                right = x[rows, self.feature[t, node]] > self.cut[t, node]
                node = 2 * node + 1 + right
            total += self.leaf[t][node - inner]
        return total
