"""Gradient-boosted trees for small tables: logistic loss, binned splits, monotonic constraints.

Fitting takes a bounded table on the driver; a fitted model is a few numpy
arrays of nodes, which score a whole matrix at once, or a Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class BoostedTrees:
    """All trees in flat arrays: node i splits ``feature[i] <= cut[i]`` to ``left[i]``, else ``right[i]``; leaves point to themselves."""

    depth: int
    base: float
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x``; all trees step down together."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def column(self, features: list[Column]) -> Column:
        """The log odds as a Spark expression over feature columns."""

        def node(i: int) -> Column:
            if self.left[i] == i:
                return F.lit(float(self.value[i]))
            return F.when(features[self.feature[i]] <= float(self.cut[i]), node(self.left[i])).otherwise(node(self.right[i]))

        total = F.lit(float(self.base))
        for root in self.roots:
            total = total + node(int(root))
        return total


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> BoostedTrees:
    """Fits on a matrix of features and 0/1 labels; ``monotone`` has +1, -1 or 0 for each feature.

    With no row, or one class only, the model is the constant base rate.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, k = x.shape
    rate_1 = np.clip((y.sum() + 0.5) / (n + 1), 1e-4, 1 - 1e-4)
    model = BoostedTrees(depth, float(np.log(rate_1 / (1 - rate_1))))
    if n < 2 * least or y.min() == y.max():
        return model
    sign = np.zeros(k, int) if monotone is None else np.asarray(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
    width = max(len(c) for c in cuts) + 1
    margin = np.full(n, model.base)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, d: int, low: float, high: float) -> int:
        me = len(nodes)
        weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        nodes.append([0, 0.0, me, me, rate * weight])
        if d == depth or len(rows) < 2 * least:
            margin[rows] += rate * weight
            return me
        best = (1e-6, -1, -1, 0.0)
        gt, ht = g[rows].sum(), h[rows].sum()
        for j in range(k):
            b = binned[rows, j]
            gs = np.cumsum(np.bincount(b, g[rows], width))[: len(cuts[j])]
            hs = np.cumsum(np.bincount(b, h[rows], width))[: len(cuts[j])]
            ns = np.cumsum(np.bincount(b, minlength=width))[: len(cuts[j])]
            if not len(gs):
                continue
            wl, wr = np.clip(-gs / (hs + l2), low, high), np.clip(-(gt - gs) / (ht - hs + l2), low, high)
            gain = -(gs * wl + 0.5 * (hs + l2) * wl**2) - ((gt - gs) * wr + 0.5 * (ht - hs + l2) * wr**2) + (gt * weight + 0.5 * (ht + l2) * weight**2)
            bad = (ns < least) | (len(rows) - ns < least) | (sign[j] * (wr - wl) < 0)
            gain[bad] = -1
            if gain.max() > best[0]:
                s = int(gain.argmax())
                best = (float(gain[s]), j, s, float((wl[s] + wr[s]) / 2))
        if best[1] < 0:
            margin[rows] += rate * weight
            return me
        _, j, s, mid = best
        goes = binned[rows, j] <= s
        ends = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(int(sign[j]), ((low, high), (low, high)))
        l = grow(rows[goes], g, h, d + 1, *ends[0])
        r = grow(rows[~goes], g, h, d + 1, *ends[1])
        nodes[me] = [j, float(cuts[j][s]), l, r, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    flat = np.array(nodes)
    model.roots, model.feature, model.cut = np.array(roots, np.int32), flat[:, 0].astype(np.int32), flat[:, 1]
    model.left, model.right, model.value = flat[:, 2].astype(np.int32), flat[:, 3].astype(np.int32), flat[:, 4]
    return model
