"""Gradient-boosted trees and isotonic calibration in numpy, for a bounded table of dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tree:
    """A complete tree of fixed depth: node i has children 2i+1 and 2i+2; the last level are leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        inner = len(self.feature)
        rows = np.arange(len(x))
        while inner and at.size and at[0] < inner:
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.leaf[at - inner]


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Logistic loss, second-order leaf values, cuts at feature quantiles."""
    mean = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(mean / (1 - mean))), rate, [])
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [np.unique(np.append(c, np.quantile(v[v > v.min()], [0.05, 0.5]) if (v > v.min()).any() else [])) for c, v in zip(cuts, x.T, strict=True)]
    coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    width = max(len(c) for c in cuts) + 1
    score = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = sigmoid(score)
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            pick = np.full((count, 2), -1)
            for f in range(x.shape[1]):
                cell = (at - first) * width + coded[:, f]
                g = np.bincount(cell, grad, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(cell, hess, count * width).reshape(count, width).cumsum(1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[:, len(cuts[f]) :] = -1
                k = gain.argmax(1)
                better = gain[np.arange(count), k] > best
                best = np.where(better, gain[np.arange(count), k], best)
                pick[better] = np.stack([np.full(count, f), k], 1)[better]
            for n in range(count):
                if pick[n, 0] >= 0:
                    feature[first + n], cut[first + n] = pick[n, 0], cuts[pick[n, 0]][pick[n, 1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = np.bincount(at - inner, grad, inner + 1) / (np.bincount(at - inner, hess, inner + 1) + ridge)
        model.trees.append(Tree(feature, cut, leaf))
        score += rate * leaf[at - inner]
    return model


@dataclass
class Isotonic:
    """A non-decreasing step function, linear between its knots."""

    knots: np.ndarray
    values: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators."""
    if not len(x):
        return Isotonic(np.zeros(1), np.zeros(1))
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, sum of x
    for xv, yv in zip(x[order], y[order], strict=True):
        pools.append([float(yv), 1.0, float(xv)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return Isotonic(np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools]))
