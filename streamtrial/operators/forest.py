"""An adaptive random forest for regression (Gomes et al. 2018), as a kernel of the fold.

Each tree learns a row as often as a Poisson draw says. A leaf looks at a random subset of the features only, keeps the
last ``grace`` rows it had, and splits where the standard deviation falls most, if the Hoeffding bound tells the best feature from the
second. Two drift detectors (adaptive windowing) follow each tree's error: the more nervous one starts a tree in
the background, the other replaces the tree by it. Predictions are the mean or the median of the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np

from streamtrial.operators.dice import Dice
from streamtrial.operators.drift import Adwin
from streamtrial.operators.plain import dot
from streamtrial.operators.trees import bound

LEAVES = ("mean", "model", "adaptive")


class _Leaf:
    """Mean of the targets, a clipped linear model, and the last rows."""

    CLIP = 10.0

    def __init__(self, width: int, features: list[int], depth: int, mean: float = 0.0, n: float = 0.0):
        self.features, self.depth, self.n, self.mean = features, depth, n, mean
        self.w, self.b, self.x, self.y = [0.0] * width, mean, [], []
        self.bad_mean = self.bad_model = 0.0  # fading absolute errors
        self.feature = None


class Tree:
    """A regression tree whose leaves split on the rows since the last attempt."""

    def __init__(self, width: int, dice, features: int, grace: int, delta: float, tie: float, depth: int | None, leaf: str, lr: float):
        self.width, self.dice, self.count, self.grace, self.delta, self.tie, self.depth, self.leaf, self.lr = width, dice, features, grace, delta, tie, depth, leaf, lr
        self.root, self.splits = _Leaf(width, self._subset(), 0), 0

    def _subset(self) -> list[int]:
        order = sorted(range(self.width), key=lambda _: self.dice.random())
        return sorted(order[: self.count])

    def _at(self, x: list[float]) -> _Leaf:
        node = self.root
        while node.feature is not None:
            node = node.left if x[node.feature] <= node.threshold else node.right
        return node

    def calm(self, x: list[float], times: int) -> bool:
        """Whether so many times the row come without an attempt to split."""
        return len(self._at(x).y) + times < self.grace

    def predict(self, x: list[float]) -> float:
        return self._said(self._at(x), x)

    def _said(self, node: _Leaf, x: list[float]) -> float:
        if self.leaf == "mean" or not node.n or (self.leaf == "adaptive" and node.bad_mean <= node.bad_model):
            return node.mean
        if len(x) == 3:
            a, b, c = x
            p, q, r = node.w
            return a * p + b * q + c * r + node.b
        return dot(node.w, x) + node.b

    def learn(self, x: list[float], y: float, times: int = 1, node: _Leaf | None = None) -> None:
        """The row so many times; between two attempts to split it meets the same leaf, first ``node`` if the caller knows it."""
        while times > 0:
            node, grace = node or self._at(x), self.grace
            now = grace - len(node.y)
            now = times if times < now else now if now > 1 else 1
            self._learned(node, x, y, now)
            times -= now
            if len(node.y) >= grace:
                if self.depth is None or node.depth < self.depth:
                    self._split(node)
                if node.feature is None:
                    node.x, node.y = [], []
            node = None

    def _learned(self, node: _Leaf, x: list[float], y: float, times: int) -> None:
        node.x += [x] * times
        node.y += [y] * times
        n, mean = node.n, node.mean
        if self.leaf == "mean":  # there is no model and none is asked for
            for _ in range(times):
                n += 1
                mean += (y - mean) / n
            node.n, node.mean = n, mean
            return
        most, lr, w, b, bad_mean, bad_model = node.CLIP, self.lr, node.w, node.b, node.bad_mean, node.bad_model
        if len(x) == 3:  # as most streams have: no loop
            u, v, t = x
            p, q, r = w
            for _ in range(times):
                error, d = y - (u * p + v * q + t * r + b), y - mean
                bad_mean = 0.95 * bad_mean + (d if d > 0 else -d)
                bad_model = 0.95 * bad_model + (error if error > 0 else -error)
                n += 1
                mean += d / n
                error = error if -most <= error <= most else min(most, max(-most, error))
                g, h, i = error * u, error * v, error * t
                p += lr * (most if g > most else -most if g < -most else g)
                q += lr * (most if h > most else -most if h < -most else h)
                r += lr * (most if i > most else -most if i < -most else i)
                b += lr * error
            w[:] = p, q, r
        else:
            for _ in range(times):
                error = y - (dot(w, x) + b)
                bad_mean = 0.95 * bad_mean + abs(y - mean)
                bad_model = 0.95 * bad_model + abs(error)
                n += 1
                mean += (y - mean) / n
                error = min(most, max(-most, error))
                for f, v in enumerate(x):
                    g = error * v
                    w[f] += lr * (most if g > most else -most if g < -most else g)
                b += lr * error
        node.b, node.n, node.mean, node.bad_mean, node.bad_model = b, n, mean, bad_mean, bad_model

    def _split(self, node: _Leaf) -> None:
        x, y = np.array(node.x), np.array(node.y)
        if y.min() == y.max() and y.std() <= 0:
            return
        found = sorted(((*cut, f) for cut, f in zip(best_cuts(x[:, node.features].T, y), node.features)), key=lambda c: (-c[0], c[2]))
        gain, threshold, feature = found[0]
        second = found[1][0] if len(found) > 1 else 0.0
        epsilon = bound(1.0, self.delta, len(y))
        if gain <= 0 or not (second / gain < 1 - epsilon or epsilon < self.tie):
            return
        left = x[:, feature] <= threshold
        for name, own in (("left", left), ("right", ~left)):
            child = _Leaf(self.width, self._subset(), node.depth + 1, float(y[own].mean()), float(own.sum()))
            if self.leaf != "mean":
                child.w, child.b = node.w.copy(), node.b
            setattr(node, name, child)
        node.feature, node.threshold, node.x, node.y = feature, float(threshold), [], []
        self.splits += 1


def best_cut(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The greatest fall of the standard deviation by a cut between two values of x, and the cut."""
    return best_cuts(x[None], y)[0]


def best_cuts(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """The same for several features, a row of ``x`` each."""
    n = len(y)
    if n < 2:
        return [(-np.inf, 0.0)] * len(x)
    gain, cut = cuts(x, np.broadcast_to(y - y.mean(), x.shape))
    return list(zip(gain.tolist(), cut.tolist()))


def cuts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, as two arrays, for rows of x and targets around their mean, two columns at least."""
    n = x.shape[1]
    order = np.argsort(np.ascontiguousarray(x), axis=1, kind="stable")
    x, y = np.take_along_axis(x, order, 1), np.ascontiguousarray(np.take_along_axis(y, order, 1))
    at, y2 = np.arange(1, n), y * y
    rest, s, q = n - at, np.cumsum(y, axis=1)[:, :-1], np.cumsum(y2, axis=1)[:, :-1]
    total, squares = y.sum(1)[:, None], y2.sum(1)[:, None]
    a = np.sqrt(np.maximum(q / at - (s / at) ** 2, 0))
    b = np.sqrt(np.maximum((squares - q) / rest - ((total - s) / rest) ** 2, 0))
    gain = np.where(x[:, 1:] > x[:, :-1], np.sqrt(squares / n) - (at * a + rest * b) / n, -np.inf)
    best, rows = gain.argmax(1), np.arange(len(x))
    top, cut = gain[rows, best], (x[rows, best] + x[rows, best + 1]) / 2
    found = np.isfinite(top)
    return np.where(found, top, -np.inf), np.where(found, cut, 0.0)


class ForestRegressor:
    """Parameters: number of ``models``, greatest ``depth``, ``grace`` rows between attempts, ``combine`` (mean or median), ``leaf`` (mean, model or adaptive)."""

    plain = together = True

    def __init__(self, width: int, models: int = 10, depth: int | None = None, grace: int = 50, combine: str = "median", leaf: str = "adaptive", rate: float = 6.0, delta: float = 0.01, tie: float = 0.05, warning: float = 0.01, drift: float = 0.001, lr: float = 0.01, seed: int = 0, **_):
        if combine not in ("mean", "median") or leaf not in LEAVES:
            raise ValueError("combine must be mean or median, leaf one of " + ", ".join(LEAVES))
        self.combine, self.rate, self.dice = combine, rate, Dice("forest", seed)
        self.settings = width, self.dice, min(width, isqrt(width) + (isqrt(width) ** 2 < width)), grace, delta, tie, depth, leaf, lr
        self.deltas = warning, drift
        self.trees = [self.new() for _ in range(models)]
        self.behind: list[Tree | None] = [None] * models
        self.told = [[Adwin(d) for d in self.deltas] for _ in range(models)]
        self.replaced = 0

    def new(self) -> Tree:
        return Tree(*self.settings)

    def predict(self, x: list[float]) -> float:
        said = [t.predict(x) for t in self.trees]
        if self.combine == "mean" or any(v != v for v in said):
            return sum(said) / len(said)
        said.sort()
        return (said[(len(said) - 1) // 2] + said[len(said) // 2]) / 2

    def learn(self, x: list[float], y: float) -> None:
        x = x if isinstance(x, list) else np.asarray(x, float).tolist()  # leaves keep it
        for i, tree in enumerate(self.trees):
            node, times, other = tree._at(x), self.dice.poisson(self.rate), self.behind[i]
            error = abs(y - tree._said(node, x))
            if other and not (tree.calm(x, times) or other.calm(x, times)):
                for _ in range(times):  # in turn: both may draw the features of new leaves
                    tree.learn(x, y)
                    other.learn(x, y)
            else:
                tree.learn(x, y, times, node)
                if other:
                    other.learn(x, y, times)
            nervous, last = self.told[i]
            warned, drifted = nervous.update(error), last.update(error)
            if drifted:
                self.trees[i], self.behind[i] = self.behind[i] or self.new(), None
                self.told[i] = [Adwin(d) for d in self.deltas]
                self.replaced += 1
            elif warned:
                self.behind[i] = self.new()
                self.told[i][0] = Adwin(self.deltas[0])

    def going(self, x: np.ndarray, y: np.ndarray) -> Iterator:
        """What a stream's rows are told, each of which is learned before the next, as strategies hand it out (``automl``)."""
        x = np.asarray(x, float)
        said = yield [(self, x, x, np.asarray(y).tolist(), None, None, None)]
        return said[0]
