"""Gradient-boosted trees over binned features, in NumPy: fitting, storing and serving."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Binary log-loss trees. All trees have the same depth, so a node's children are found by counting."""

    def __init__(self, edges: list[np.ndarray], base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        #: edges of the bins of each feature; per tree: feature and bin of each inner node, value of each leaf
        self.edges, self.base, self.feature, self.cut, self.leaf = edges, base, feature, cut, leaf

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def bins(self, x: np.ndarray, wanted: list[int] | None = None) -> np.ndarray:
        """Bins of all or the wanted features."""
        wanted = range(len(self.edges)) if wanted is None else wanted
        out = np.empty((len(x), len(wanted)), np.uint8)
        for k, j in enumerate(wanted):
            out[:, k] = np.searchsorted(self.edges[j], x[:, j], "right")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        used = np.unique(self.feature)
        place = np.zeros(len(self.edges), np.int64)
        place[used] = np.arange(len(used))
        b = self.bins(x, used.tolist())
        out = np.full(len(b), self.base, np.float32)
        if not len(b):
            return out
        rows = np.arange(len(b)) * b.shape[1]
        flat = b.ravel()
        for feature, cut, leaf in zip(place[self.feature], self.cut, self.leaf):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[rows + feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out

    def dump(self) -> dict:
        return {"edges": [e.tolist() for e in self.edges], "base": self.base, "feature": self.feature.tolist(), "cut": self.cut.tolist(), "leaf": np.round(self.leaf, 4).tolist()}

    @classmethod
    def load(cls, d: dict) -> Boosted:
        return cls([np.array(e, np.float32) for e in d["edges"]], d["base"], np.array(d["feature"], np.int64), np.array(d["cut"], np.int16), np.array(d["leaf"], np.float32))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Trees fitted by second-order boosting with histograms."""
    edges = []
    for j in range(x.shape[1]):
        distinct = np.unique(x[:, j])
        if len(distinct) > BINS:
            distinct = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(np.unique(((distinct[1:] + distinct[:-1]) / 2).astype(np.float32)))
    inner = 2**depth - 1
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(edges, float(np.log(prior / (1 - prior))), np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int16), np.zeros((trees, inner + 1), np.float32))
    b = model.bins(x)
    total = np.full(len(y), model.base)
    width = BINS + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            for j in range(x.shape[1]):
                key = local * width + b[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                at = gain[:, :-1].argmax(1)
                value = gain[np.arange(count), at]
                better = value > best
                best[better] = value[better]
                model.feature[t, first : first + count][better] = j
                model.cut[t, first : first + count][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), model.feature[t][node]] > model.cut[t][node])
        leaf = node - inner
        model.leaf[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += model.leaf[t][leaf]
    return model
