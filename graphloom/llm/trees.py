"""Gradient-boosted trees for two classes on small tables of features, in numpy, and their form as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0  # goes left if the value is <= cut
    left: "Node | None" = None
    right: "Node | None" = None
    value: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.left.apply(x[low]), self.right.apply(x[~low])
        return out

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= F.lit(self.cut), self.left.column(features)).otherwise(self.right.column(features))

    def paths(self, so_far: tuple = ()) -> list[tuple]:
        """Every path from the root to an inner node or leaf, as conditions (feature, is_low, cut)."""
        own = [so_far] if so_far else []
        if self.left is None:
            return own
        return own + self.left.paths((*so_far, (self.feature, True, self.cut))) + self.right.paths((*so_far, (self.feature, False, self.cut)))


def _grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    g, h = gradient[rows].sum(), curve[rows].sum()
    leaf = Node(value=float(g / (h + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, where = 1e-6, None
    for f in range(codes.shape[1]):
        if not len(cuts[f]):
            continue
        c = codes[rows, f]
        bins = len(cuts[f]) + 1
        gl, hl, nl = (np.cumsum(np.bincount(c, w, bins))[:-1] for w in (gradient[rows], curve[rows], None))
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        gain[(nl < least) | (len(rows) - nl < least)] = 0
        i = int(gain.argmax())
        if gain[i] > best:
            best, where = gain[i], (f, i)
    if where is None:
        return leaf
    f, i = where
    low = codes[rows, f] <= i
    return Node(f, float(cuts[f][i]), _grow(codes, cuts, gradient, curve, rows[low], depth - 1, least, ridge), _grow(codes, cuts, gradient, curve, rows[~low], depth - 1, least, ridge))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    base: float
    trees: list[Node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.apply(x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5, bins: int = 64, ridge: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss over quantile bins; without rows, or with one class, a constant."""
    if not len(y):
        return BoostedTrees(0.0, [])
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = BoostedTrees(float(np.log(mean / (1 - mean))), [])
    if y.min() == y.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)))
        cuts.append((values[1:] + values[:-1]) / 2)
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), model.base)
    for _ in range(trees):
        p = sigmoid(score)
        tree = _grow(codes, cuts, y - p, p * (1 - p), np.arange(len(y)), depth, least, ridge)
        if tree.left is None:
            break
        _scale(tree, rate)
        model.trees.append(tree)
        score += tree.apply(x)
    return model


def _scale(node: Node, rate: float) -> None:
    node.value *= rate
    if node.left is not None:
        _scale(node.left, rate)
        _scale(node.right, rate)
