"""Gradient-boosted regression trees on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Least-squares boosting; a full binary tree of ``depth`` levels a round.

    With ``start`` the first guess is that column of the features, not the mean, and the trees learn what it
    misses.
    """

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    min_leaf: int = 4
    start: int | None = None
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    #: For each round: feature and bin at each inner node (level order), value of each leaf.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def _first(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.base) if self.start is None else x[:, self.start].astype(float)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        b = self._binned(x)
        self.base = float(np.mean(y)) if len(y) and self.start is None else 0.0
        self.trees = []
        at = self._first(x)
        inner = 2**self.depth - 1
        n_features = x.shape[1]
        flat = b + np.arange(n_features) * self.bins
        for _ in range(self.rounds if len(y) else 0):
            rest = y - at
            node = np.zeros(len(y), dtype=int)
            features, cuts = np.full(inner, -1), np.zeros(inner, dtype=int)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                f, c = self._split(flat[rows], rest[rows], n_features)
                features[k], cuts[k] = f, c
                right = b[rows, f] > c if f >= 0 else np.zeros(len(rows), dtype=bool)
                node[rows] = 2 * k + 1 + right
            values = np.zeros(inner + 1)
            for leaf in range(inner + 1):
                rows = node == inner + leaf
                if rows.any():
                    values[leaf] = self.rate * rest[rows].sum() / (rows.sum() + 1.0)
            self.trees.append((features, cuts, values))
            at = at + values[node - inner]
        return self

    def _split(self, flat: np.ndarray, rest: np.ndarray, n_features: int) -> tuple[int, int]:
        n = len(rest)
        if n < 2 * self.min_leaf:
            return -1, 0
        size = n_features * self.bins
        counts = np.bincount(flat.ravel(), minlength=size).reshape(n_features, self.bins)
        sums = np.bincount(flat.ravel(), weights=np.repeat(rest, n_features), minlength=size).reshape(n_features, self.bins)
        left_n, left_s = counts.cumsum(1), sums.cumsum(1)
        right_n, right_s = n - left_n, rest.sum() - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_s**2 / left_n + right_s**2 / right_n
        gain[(left_n < self.min_leaf) | (right_n < self.min_leaf)] = -np.inf
        k = int(np.argmax(gain))
        f, c = divmod(k, self.bins)
        return (f, c) if gain[f, c] > rest.sum() ** 2 / n + 1e-9 else (-1, 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = self._first(x)
        if not len(x) or not self.trees:
            return out
        b = self._binned(x)
        inner = 2**self.depth - 1
        rows = np.arange(len(x))
        for features, cuts, values in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = features[node]
                node = 2 * node + 1 + ((f >= 0) & (b[rows, f] > cuts[node]))
            out += values[node - inner]
        return out
