"""Small gradient-boosted trees: fitted on the driver over a bounded table, applied as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: "Split | Leaf"  # value <= threshold
    high: "Split | Leaf"


Tree = Split | Leaf


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, bins: list[np.ndarray]) -> Tree:
    """A regression tree by second-order gain; equal gains go to the first feature and threshold."""
    total_g, total_h = gradient.sum(), hessian.sum()
    leaf = Leaf(float(-total_g / (total_h + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best = (1e-6, -1, 0.0)
    base = total_g**2 / (total_h + 1.0)
    for f, cuts in enumerate(bins):
        if not len(cuts):
            continue
        slot = np.searchsorted(cuts, x[:, f], side="left")
        n = np.cumsum(np.bincount(slot, minlength=len(cuts) + 1))[:-1]
        g = np.cumsum(np.bincount(slot, gradient, len(cuts) + 1))[:-1]
        h = np.cumsum(np.bincount(slot, hessian, len(cuts) + 1))[:-1]
        gain = g**2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
        gain[(n < least) | (len(x) - n < least)] = -1.0
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, float(cuts[k]))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Split(
        best[1], best[2],
        grow(x[low], gradient[low], hessian[low], depth - 1, least, bins),
        grow(x[~low], gradient[~low], hessian[~low], depth - 1, least, bins),
    )


def quantile_cuts(x: np.ndarray, most: int = 24) -> list[np.ndarray]:
    """Per feature, values that split it; the largest is no cut."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > most:
            values = np.unique(np.quantile(column, np.linspace(0, 1, most + 2)[1:-1], method="lower"))
            values = values[values < column.max()]
        else:
            values = values[:-1]
        out.append(values)
    return out


def value_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.threshold, value_of(tree.low, x), value_of(tree.high, x))


@dataclass(frozen=True)
class Boosted:
    """Trees whose values add up to the logarithm of the odds."""

    bias: float
    rate: float
    trees: tuple[Tree, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((value_of(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The probability as an expression over the features."""

        def expression(tree: Tree) -> Column:
            if isinstance(tree, Leaf):
                return F.lit(tree.value)
            return F.when(features[tree.feature] <= F.lit(tree.threshold), expression(tree.low)).otherwise(expression(tree.high))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + expression(tree)
        return 1.0 / (1.0 + F.exp(-(F.lit(self.bias) + F.lit(self.rate) * total)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 2, rate: float = 0.3, least: int = 5, weights: np.ndarray | None = None) -> Boosted:
    """Logistic boosting; y holds 0 and 1.  Without rows of both kinds the model is a constant."""
    w = np.ones(len(y)) if weights is None else weights
    share = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    trees: list[Tree] = []
    if len(np.unique(y)) == 2:
        bins, raw = quantile_cuts(x), np.full(len(y), bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = grow(x, w * (p - y), w * p * (1 - p), depth, least, bins)
            trees.append(tree)
            raw += rate * value_of(tree, x)
    return Boosted(bias, rate, tuple(trees))
