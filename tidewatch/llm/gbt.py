"""Gradient-boosted trees for binary labels in numpy, with monotonic constraints and flat node arrays.

The trees are trained on a bounded sample of labelled rows that the caller collects; a fitted model is a handful of
arrays, small enough to travel in a task's closure, and it scores whole batches at once.  ``to_column`` writes the same
trees as nested ``CASE`` expressions for plans that may not run Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Node arrays of all trees; a leaf has feature -1 and points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def to_column(self, features: list[Column]) -> Column:
        """The probability as a Spark expression."""

        def node(i: int) -> Column:
            f = int(self.feature[i])
            if f < 0:
                return F.lit(float(self.value[i]))
            return F.when(features[f] <= float(self.threshold[i]), node(int(self.left[i]))).otherwise(node(int(self.right[i])))

        total = F.lit(float(self.base))
        for root in self.roots:
            total = total + node(int(root))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def constant(probability: float) -> Trees:
    """A model that knows only the share of positive labels."""
    p = min(max(probability, 1e-6), 1 - 1e-6)
    zero = np.zeros(1, dtype=np.int32)
    return Trees(zero - 1, np.zeros(1), zero, zero, np.zeros(1), zero[:0], float(np.log(p / (1 - p))), 0)


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    min_leaf: int = 5,
    ridge: float = 1.0,
    monotone: dict[int, int] | None = None,
    weight: np.ndarray | None = None,
) -> Trees:
    """Boost ``trees`` regression trees on the logistic loss.

    ``monotone`` maps a feature to +1 (the score may only rise with it) or -1.  A split against the sign is refused, and
    the midpoint of its children bounds what lies below, so the constraint holds for the whole tree.  Rows with one
    class only, or no rows, give a constant model.
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
    monotone = monotone or {}
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log((w * y).sum() / (w * (1 - y)).sum()))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new() -> int:
        i = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(i)
        right.append(i)
        value.append(0.0)
        return i

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        root = new()
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            i, rows, low, high, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[i] = rate * float(np.clip(gs / (hs + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * min_leaf:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    vl = np.clip(gl / (hl + ridge), low, high)
                    vr = np.clip((gs - gl) / (hs - hl + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    ok = (nl >= min_leaf) & (len(rows) - nl >= min_leaf)
                    if sign := monotone.get(j):
                        ok &= sign * (vr - vl) >= 0
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                margin[rows] += value[i]
                continue
            j, k, vl, vr = best[1]
            feature[i], threshold[i] = j, float(edges[j][k])
            left[i], right[i] = new(), new()
            to_left = binned[rows, j] <= k
            bounds = [(low, high), (low, high)]
            if sign := monotone.get(j):
                mid = (vl + vr) / 2
                bounds = [(low, mid), (mid, high)] if sign > 0 else [(mid, high), (low, mid)]
            open_nodes.append((left[i], rows[to_left], *bounds[0], level + 1))
            open_nodes.append((right[i], rows[~to_left], *bounds[1], level + 1))
    as_int = lambda a: np.array(a, dtype=np.int32)
    return Trees(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), base, depth)
