"""Gradient-boosted trees for two classes, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the nondecreasing fit of y by x, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    values, first = np.unique(x, return_index=True)
    sums = np.add.reduceat(y, first)
    counts = np.diff(np.append(first, len(y))).astype(float)
    pools: list[list[float]] = []  # mean, weight, sum of x by weight
    for value, total, count in zip(values, sums, counts, strict=True):
        pools.append([total / count, count, value * count])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, weight, place = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + mean * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += place
    table = np.array(pools)
    # each pool counts as if it had seen one case of either class more, in proportion to the prior
    prior = y.mean()
    return table[:, 2] / table[:, 1], (table[:, 0] * table[:, 1] + prior) / (table[:, 1] + 1)


@dataclass
class Boosted:
    """Trees of fixed depth over binned features, kept as arrays and walked for all rows at once."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    smooth: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # features that are zero nearly always still need their smallest other value as an edge
        for j, edge in enumerate(self.edges):
            other = x[:, j][x[:, j] > x[:, j].min()]
            if other.size:
                self.edges[j] = np.unique(np.append(edge, np.quantile(other, [0, 0.25, 0.5, 0.75])))
        codes = self.binned(x)
        width = max(len(e) for e in self.edges) + 1
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-margin))
            gradient, weight = y - chance, chance * (1 - chance)
            node = np.zeros(len(y), np.int64)
            features, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            for level in range(self.depth):
                start, many = 2**level - 1, 2**level
                best = np.zeros(many)
                for j in range(x.shape[1]):
                    slot = (node - start) * width + codes[:, j]
                    g = np.bincount(slot, gradient, many * width).reshape(many, width)
                    h = np.bincount(slot, weight, many * width).reshape(many, width)
                    left_g, left_h = g.cumsum(1), h.cumsum(1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + self.smooth) + (all_g - left_g) ** 2 / (all_h - left_h + self.smooth)
                    gain -= all_g**2 / (all_h + self.smooth)
                    gain[(left_h < 1) | (all_h - left_h < 1)] = 0
                    at = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(many), at] > best + 1e-9)
                    best[better] = gain[better, at[better]]
                    features[start + better], cuts[start + better] = j, at[better]
                node = 2 * node + 1 + (codes[np.arange(len(y)), features[node]] > cuts[node])
            leaf = node - (2**self.depth - 1)
            g, h = (np.bincount(leaf, v, 2**self.depth) for v in (gradient, weight))
            values = self.rate * g / (h + self.smooth)
            self.trees.append((features, cuts, values))
            margin += values[leaf]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        codes, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for features, cuts, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[rows, features[node]] > cuts[node])
            out += values[node - (2**self.depth - 1)]
        return out


@dataclass
class Calibrated:
    """Trees over all rows; the calibration is learned on margins of trees that did not see the row."""

    trees: Boosted | None
    points: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, folds: int = 4) -> Calibrated:
        """With no rows the score is 0; with one class it is the rate of the class, shrunk by one case."""
        if len(y) < 2 * folds or y.min() == y.max():
            rate = float(y.sum() / (len(y) + 1)) if len(y) else 0.0
            return cls(None, (np.array([0.0]), np.array([rate])))
        fold = np.arange(len(y)) % folds
        margins = np.zeros(len(y))
        for k in range(folds):
            rest = fold != k
            margins[~rest] = Boosted().fit(x[rest], y[rest]).margins(x[~rest])
        return cls(Boosted().fit(x, y), isotonic(margins, y))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.points[1][0])
        margins = self.trees.margins(x)
        calibrated = np.interp(margins, *self.points)
        # a step's rows keep the order of their margins
        return np.clip(calibrated + 1e-6 * (1 / (1 + np.exp(-margins)) - 0.5), 0.0, 1.0)
