"""Small gradient-boosted trees: grown by numpy on a bounded table, applied as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

#: A node is a leaf value or (feature, threshold, left, right); x <= threshold goes left.
Tree = float | tuple


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, least: int) -> Tree:
    """A regression tree on the residuals with Newton leaf values."""
    leaf = float(residual.sum() / max(weight.sum(), 1e-9))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, cut = 1e-9, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        values, sums, sizes = x[order, j], np.cumsum(residual[order]), np.arange(1, len(x) + 1)
        ends = np.flatnonzero(values[:-1] < values[1:])
        ends = ends[(sizes[ends] >= least) & (len(x) - sizes[ends] >= least)]
        if len(ends):
            gain = sums[ends] ** 2 / sizes[ends] + (sums[-1] - sums[ends]) ** 2 / (len(x) - sizes[ends]) - sums[-1] ** 2 / len(x)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, cut = gain[k], (j, float((values[ends[k]] + values[ends[k] + 1]) / 2))
    if cut is None:
        return leaf
    left = x[:, cut[0]] <= cut[1]
    return (*cut, _grow(x[left], residual[left], weight[left], depth - 1, least), _grow(x[~left], residual[~left], weight[~left], depth - 1, least))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, threshold, left, right = tree
    return np.where(x[:, feature] <= threshold, _value(left, x), _value(right, x))


def score(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((_value(t, x) for t in trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 4) -> list[Tree]:
    """Trees whose sum is the log-odds of y (logistic loss)."""
    trees: list[Tree] = []
    total = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _scaled(_grow(x, y - p, np.maximum(p * (1 - p), 1e-3), depth, least), rate)
        trees.append(tree)
        total += _value(tree, x)
    return trees


def _scaled(tree: Tree, rate: float) -> Tree:
    if not isinstance(tree, tuple):
        return round(float(np.clip(tree, -4, 4)) * rate, 6)
    return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))


def calibrated_threshold(trees: list[Tree], x: np.ndarray, y: np.ndarray, precision: float = 0.95) -> float:
    """The least score, midway to the next lower one, above which held-out rows keep the precision; never below even odds."""
    if not len(x):
        return 0.0
    s = score(trees, x)
    best = float("inf")
    for t in np.unique(s)[::-1]:
        if y[s >= t].mean() >= precision:
            lower = s[s < t]
            best = float((t + lower.max()) / 2 if len(lower) else t)
    return max(0.0, best)


def tree_sql(trees: list[Tree], features: list[str]) -> str:
    """The trees' sum as one SQL expression over SQL operands."""

    def node(tree: Tree) -> str:
        if not isinstance(tree, tuple):
            return f"{float(tree)!r}D"
        feature, threshold, left, right = tree
        return f"CASE WHEN {features[feature]} <= {threshold!r}D THEN {node(left)} ELSE {node(right)} END"

    return "(" + " + ".join(map(node, trees)) + ")"


def tree_column(trees: list[Tree], features: list[str]) -> Column:
    return F.expr(tree_sql(trees, features))
