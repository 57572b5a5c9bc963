"""Incremental trees, as kernels for the fold.

A leaf keeps per class (or for the target) weight, mean and squared deviations of every feature as arrays.
Every ``grace`` rows it looks for a split at the features' means, with the normal distribution giving the
share that goes left, and splits by the Hoeffding bound; children inherit the leaf's statistics in proportion. Learning a row
is plain numbers: there are few features.
"""

from __future__ import annotations

from math import erf, exp, log, log2, sqrt

import numpy as np

from streamtrial.operators.plain import dot


def bound(spread: float, delta: float, n: float) -> float:
    """Hoeffding bound."""
    return sqrt(spread * spread * log(1 / delta) / (2 * n)) if n > 0 else spread


def cdf(x: float, mean: float, std: float) -> float:
    return 0.5 * (1 + erf((x - mean) / (std * sqrt(2)))) if std > 0 else float(x >= mean)


class Moments:
    """Weight, mean and squared deviations of several values at once."""

    def __init__(self, width: int):
        self.n, self.mean, self.m2 = 0.0, [0.0] * width, [0.0] * width

    def add(self, x: list[float]) -> None:
        self.n = n = self.n + 1
        mean, m2 = self.mean, self.m2
        for f, v in enumerate(x):
            d = v - mean[f]
            mean[f] = m = mean[f] + d / n
            m2[f] += d * (v - m)

    def std(self) -> list[float]:
        return [sqrt(v / (self.n - 1)) for v in self.m2] if self.n > 1 else [0.0] * len(self.mean)

    def part(self, share: float) -> Moments:
        out = Moments(len(self.mean))
        out.n, out.mean, out.m2 = self.n * share, self.mean.copy(), [v * share for v in self.m2]
        return out


class _Node:
    feature: int | None = None

    def leaf(self, x: np.ndarray) -> tuple["_Node", int]:
        node, depth = self, 0
        while node.feature is not None:
            node, depth = (node.left if x[node.feature] <= node.threshold else node.right), depth + 1
        return node, depth


def _chosen(scores: list[float], epsilon: float, tie: float) -> int | None:
    """The best of the scores if it wins by the bound, or all are close and the bound is tight; the first of equals."""
    if not scores:
        return None
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    second = max((s for i, s in enumerate(scores) if i != best), default=-np.inf)
    lead = scores[best] - second
    return best if scores[best] > 0 and (lead > epsilon or (lead < tie and epsilon < tie)) else None


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Gini index or entropy of counts per class, over the last axis; 0 without any."""
    total = counts.sum(-1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    if criterion == "gini":
        return np.where(total[..., 0] > 0, 1 - (p * p).sum(-1), 0.0)
    return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(-1)


def best_split(n: np.ndarray, mean: np.ndarray, std: np.ndarray, seen: int, delta: float, tie: float, criterion: str) -> tuple[int, float, list[float]] | None:
    """Feature, threshold and the share of each class that goes left, if a leaf is to be split.

    ``n``: per class; ``mean`` and ``std``: class x feature; ``seen``: classes that the whole tree has had.
    """
    thresholds = n @ mean / n.sum()
    left = np.array([[cdf(t, m, s) for m, s in zip(*column)] for t, column in zip(thresholds, zip(mean.T, std.T))])  # feature x class
    a, b = n * left, n * (1 - left)
    scores = impurity(n, criterion) - (a.sum(1) * impurity(a, criterion) + b.sum(1) * impurity(b, criterion)) / n.sum()
    f = _chosen(scores.tolist(), bound(1.0 if criterion == "gini" else log2(max(seen, 1)), delta, float(n.sum())), tie)
    return None if f is None else (f, float(thresholds[f]), left[f].tolist())


def best_splits(n: np.ndarray, mean: np.ndarray, std: np.ndarray, seen: int, delta: float, tie: float, criterion: str) -> list[tuple[int, float, list[float]] | None]:
    """``best_split`` of many leaves, leaf by class (by feature), where a leaf may lack classes."""
    if not len(n):
        return []
    total = n.sum(1)
    thresholds = np.stack([(own[own > 0] @ m[own > 0]) / t for own, m, t in zip(n, mean, total)])
    shape = len(n), mean.shape[2], mean.shape[1]  # leaf, feature, class
    at, m, s = (np.broadcast_to(v, shape).ravel().tolist() for v in (thresholds[:, :, None], mean.transpose(0, 2, 1), std.transpose(0, 2, 1)))
    left = np.array(list(map(cdf, at, m, s))).reshape(shape)
    a, b = n[:, None] * left, n[:, None] * (1 - left)
    scores = impurity(n, criterion)[:, None] - (a.sum(2) * impurity(a, criterion) + b.sum(2) * impurity(b, criterion)) / total[:, None]
    size, out = 1.0 if criterion == "gini" else log2(max(seen, 1)), []
    for i, (own, t) in enumerate(zip(scores.tolist(), total.tolist())):
        f = _chosen(own, bound(size, delta, t), tie)
        out.append(None if f is None else (f, float(thresholds[i, f]), left[i, f, n[i] > 0].tolist()))
    return out


class HoeffdingTree:
    """Classifier; a leaf predicts its majority class, or by naive Bayes from ``nb_threshold`` rows on if that is set."""

    plain = True

    def __init__(self, width: int, grace: int = 200, delta: float = 1e-7, tie: float = 0.05, nb_threshold: int = 0, depth: int = 20, criterion: str = "info_gain", **_):
        self.width, self.grace, self.delta, self.tie, self.nb, self.depth, self.criterion = width, grace, delta, tie, nb_threshold, depth, criterion
        self.root, self.seen = self._leaf(), set()

    def _leaf(self) -> _Node:
        node = _Node()
        node.weight, node.counts, node.stats = 0.0, {}, {}
        return node

    def learn(self, x: np.ndarray, y: int) -> None:
        self.seen.add(y)
        node, depth = self.root.leaf(x)
        node.counts[y] = node.counts.get(y, 0.0) + 1
        node.weight += 1
        if (own := node.stats.get(y)) is None:
            own = node.stats[y] = Moments(self.width)
        own.add(x)
        if int(node.weight) % self.grace == 0 and depth < self.depth and node.weight >= 2 and len(self.seen) > 1:
            self._split(node)

    def _split(self, node: _Node) -> None:
        classes = sorted(node.counts)
        stats = [node.stats[c] for c in classes]
        found = best_split(np.array([node.counts[c] for c in classes]), np.array([m.mean for m in stats]), np.array([m.std() for m in stats]), len(self.seen), self.delta, self.tie, self.criterion)
        if found is None:
            return
        node.left, node.right = self._leaf(), self._leaf()
        for c, share in zip(classes, found[2]):
            for child, part in ((node.left, share), (node.right, 1 - share)):
                child.weight += node.counts[c] * part
                if node.counts[c] * part > 0:
                    child.counts[c] = node.counts[c] * part
                    child.stats[c] = node.stats[c].part(part)
        node.feature, node.threshold = found[:2]
        node.counts, node.stats, node.weight = {}, {}, 0.0

    def predict(self, x: np.ndarray) -> int:
        node, _ = self.root.leaf(x)
        if not node.counts:
            return 0
        if not (self.nb > 0 and node.weight >= self.nb):
            best, top = None, -1.0
            for c, n in node.counts.items():
                if n > top or (n == top and c < best):
                    best, top = c, n
            return best
        return min(node.counts, key=lambda c: (-self._log_likelihood(node, c, x), c))

    def _log_likelihood(self, node: _Node, c: int, x: np.ndarray) -> float:
        m, total = node.stats[c], log(node.counts[c] / node.weight)
        for f in range(self.width):
            var = m.m2[f] / (m.n - 1) if m.n > 1 else 0.0
            if m.n < 2:
                density = 0.0
            elif var <= 0:
                density = float(x[f] == m.mean[f])
            else:
                density = exp(-0.5 * (x[f] - m.mean[f]) ** 2 / var) / sqrt(2 * np.pi * var)
            total += log(max(density, 1e-300))
        return total

    def proba(self, x: np.ndarray) -> dict[int, float]:
        node, _ = self.root.leaf(x)
        total = sum(node.counts.values())
        return {c: node.counts[c] / total for c in sorted(node.counts)} if total else {}


def extremely_fast(width: int, delta: float = 1e-5, **params) -> HoeffdingTree:
    """The same tree with a looser bound; splits are not revised."""
    return HoeffdingTree(width, delta=delta, criterion="info_gain", **params)


class GradientLeaf:
    """Stochastic gradient tree as the published recurrence gives it: with a positive penalty no split has a
    gain, so it is one leaf whose weight follows the label sequence; classes above 0 count as 1."""

    plain = True

    def __init__(self, width: int, lr: float = 0.1, penalty: float = 0.1, grace: int = 200, depth: int = 6, **_):
        # rows between attempts and depth are accepted, but no attempt ever splits
        self.lr, self.penalty, self.w, self.g, self.h = lr, penalty, 0.0, 0.0, 0.0

    def predict(self, x: np.ndarray) -> int:
        return int(self.w >= 0)

    def proba(self, x: np.ndarray) -> dict[int, float]:
        p = 1 / (1 + exp(-max(-500.0, min(500.0, self.w))))
        return {0: 1 - p, 1: p}

    def learn(self, x: np.ndarray, y: int) -> None:
        p = 1 / (1 + exp(-max(-500.0, min(500.0, self.w))))
        self.g += p - (y > 0)
        self.h += max(p * (1 - p), 1e-6)
        self.w -= self.lr * self.g / (self.h + self.penalty)


class HoeffdingRegressor:
    """Regression tree with a clipped linear model per leaf; it predicts the target's mean until a leaf had ``grace`` rows."""

    plain = True
    CLIP = 10.0

    def __init__(self, width: int, grace: int = 200, delta: float = 1e-7, tie: float = 0.05, depth: int = 20, lr: float = 0.01, **_):
        self.width, self.grace, self.delta, self.tie, self.depth, self.lr = width, grace, delta, tie, depth, lr
        self.root = self._leaf(Moments(1), Moments(width), [0.0] * width, 0.0, 0)

    @staticmethod
    def _leaf(target: Moments, stats: Moments, w: list[float], b: float, rows: int) -> _Node:
        node = _Node()
        node.target, node.stats, node.w, node.b, node.rows = target, stats, w, b, rows
        return node

    def predict(self, x: np.ndarray) -> float:
        node, _ = self.root.leaf(x)
        return dot(node.w, x) + node.b if node.rows >= self.grace else node.target.mean[0]

    def learn(self, x: np.ndarray, y: float) -> None:
        node, depth = self.root.leaf(x)
        node.target.add([y])
        node.rows += 1
        stats, w, lr, most = node.stats, node.w, self.lr, self.CLIP
        stats.n = n = stats.n + 1
        mean, m2 = stats.mean, stats.m2
        error = min(most, max(-most, y - (dot(w, x) + node.b)))
        for f, v in enumerate(x):
            d = v - mean[f]
            mean[f] = m = mean[f] + d / n
            m2[f] += d * (v - m)
            g = error * v
            w[f] += lr * (most if g > most else -most if g < -most else g)
        node.b += lr * error
        if node.rows % self.grace == 0 and depth < self.depth and node.rows >= 2:
            self._split(node)

    def _split(self, node: _Node) -> None:
        spread = node.target.std()[0]
        if spread <= 0:
            return
        std = node.stats.std()
        left = [min(0.99, max(0.01, cdf(m, m, s))) for m, s in zip(node.stats.mean, std)]
        scores = [spread * (1 - p * sqrt(p) - (1 - p) * sqrt(1 - p)) for p in left]
        f = _chosen(scores, bound(spread, self.delta, node.rows), self.tie)
        if f is None:
            return
        node.left, node.right = (self._leaf(node.target.part(p), node.stats.part(p), node.w.copy(), node.b, int(node.rows * p)) for p in (left[f], 1 - left[f]))
        node.feature, node.threshold = f, node.stats.mean[f]
