"""Kernels of the fold beside the linear ones and trees: naive Bayes, nearest neighbours, seeded bagging.

``naive_bayes.py`` and ``neighbours.py`` run the first two over one large stream without a fold; these are for
pools of configurations, suites and live streams, where a learner is a small state.
"""

from __future__ import annotations

from bisect import insort
from functools import cache
from math import exp, log, pi, sqrt

import numpy as np

from streamtrial.operators.plain import each_step, made

FLOOR = log(1e-300)


class NaiveBayes:
    """Gaussian naive Bayes from running moments; -1 before any row, ties to the smaller class."""

    plain = True

    def __init__(self, width: int, **_):
        self.width, self.classes, self.total = width, [], 0.0
        self.stats: dict[int, list] = {}  # class: [n, means, squared deviations, densities' terms or None if they are to be made anew]

    def _terms(self, own: list) -> list[tuple[float, float]]:
        """Per feature (1 / (2 variance), log of the normal factor), or (0, 0) without variance."""
        n, _, m2, _ = own
        own[3] = [(0.5 / v, 0.5 * log(2 * pi * v)) if n >= 2 and v > 0 else (0.0, 0.0) for v in (m / max(n - 1, 1.0) for m in m2)]
        return own[3]

    def _scores(self, x: list[float]) -> dict[int, float]:
        out = {}
        for c in self.classes:
            own = self.stats[c]
            n, mean = own[0], own[1]
            z = 0.0
            for v, m, (half, norm) in zip(x, mean, own[3] or self._terms(own)):
                d = v - m
                if half:
                    density = -(d * d * half + norm)
                    z += density if density > FLOOR or density != density else FLOOR
                else:
                    z += 0.0 if n >= 2 and abs(d) <= 1e-9 else FLOOR
            out[c] = log(n / self.total) + z
        return out

    def predict(self, x: list[float]) -> int:
        z = self._scores(x)
        return max(z, key=z.get) if z else -1  # classes ascend: of equals the smallest

    def proba(self, x: list[float]) -> dict[int, float]:
        return self._shares(self._scores(x))

    def steps(self, before: list, after: list, y: list, times: list | None, shares: list | None, then: list | None) -> list:
        if shares is None or then is not None:
            return each_step(self, before, after, y, times, shares, then)
        out, at = [], 0
        for i, (x, label) in enumerate(zip(before, y)):
            z = self._scores(x)
            out.append(max(z, key=z.get) if z else -1)
            shares.append(self._shares(z))
            end = at + (1 if times is None else times[i])
            for view in after[at:end]:
                self.learn(view, label)
            at = end
        return out

    @staticmethod
    def _shares(z: dict[int, float]) -> dict[int, float]:
        top = max(z.values(), default=0.0)
        e = {c: exp(v - top) for c, v in z.items()}
        total = sum(e.values())
        return {c: v / total for c, v in e.items()}

    def learn(self, x: list[float], y: int) -> None:
        own = self.stats.get(y)
        if own is None:
            insort(self.classes, y)
            own = self.stats[y] = [0.0, [0.0] * self.width, [0.0] * self.width, None]
        own[0] = n = own[0] + 1.0
        self.total += 1.0
        _, mean, m2, _ = own
        for f, v in enumerate(x):
            d = v - mean[f]
            mean[f] = m = mean[f] + d / n
            m2[f] += d * (v - m)
        own[3] = None


#: Columns of a group whose least value stands for it.
GROUP = 16


def least_of_groups(total: np.ndarray) -> np.ndarray:
    """The least value of each row's groups: column g + i * groups is in group g; the last columns may be in none."""
    groups, size = total.shape[1] // GROUP, GROUP
    least = total[:, : groups * size]
    while size > 1:
        size //= 2
        least = np.minimum(least[:, : groups * size], least[:, groups * size :])
    return least


def kth_or_more(total: np.ndarray, k: int, least: np.ndarray | None = None) -> np.ndarray:
    """Of each row a bound that is at least its k-th smallest value: the k-th smallest of the least values of groups, where there are enough of them."""
    if total.shape[1] // GROUP >= 2 * k:
        bound = np.partition(least_of_groups(total) if least is None else least, k - 1, axis=1)[:, k - 1]
        if not np.isnan(bound).any():
            return bound
    return np.partition(total, k - 1, axis=1)[:, k - 1]


def upto(total: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places in the flat ``total`` of values up to each row's bound, in order; only groups whose least value is are looked through."""
    groups, wide = least.shape[1], total.shape[1]
    if not groups or np.isnan(least).any():
        return np.flatnonzero(total <= bound[:, None])
    hit = np.flatnonzero(least <= bound[:, None])
    of, group = np.divmod(hit, groups)
    places = ((of * wide + group)[:, None] + np.arange(GROUP) * groups).ravel()
    places = places[total.ravel()[places] <= np.repeat(bound[of], GROUP)]
    rest = groups * GROUP
    of, at = np.nonzero(total[:, rest:] <= bound[:, None])
    return np.sort(np.append(places, of * wide + at + rest))


class _Window:
    """The last ``window`` rows in a ring, a row of ``x`` per feature; the k nearest by Minkowski distance, ties by target and then age."""

    plain = True

    def __init__(self, width: int, k: int = 5, window: int = 1000, p: float = 2, **_):
        self.k, self.window, self.p, self.n = k, window, p, 0
        self.x, self.y = np.zeros((width, min(64, window))), np.zeros(min(64, window))

    def learn(self, x: list[float], y: float) -> None:
        if self.n == len(self.y) < self.window:
            more = min(len(self.y), self.window - len(self.y))
            self.x, self.y = np.hstack([self.x, np.zeros((len(self.x), more))]), np.append(self.y, np.zeros(more))
        at = self.n % self.window
        self.x[:, at], self.y[at] = x, y
        self.n += 1

    def _distances(self, x: list[float], have: int) -> np.ndarray:
        total = None
        for v, own in zip(x, self.x):
            d = own[:have] - v
            d = d * d if self.p == 2 else np.abs(d) if self.p == 1 else np.abs(d) ** self.p
            total = d if total is None else np.add(total, d, out=total)
        return np.zeros(have) if total is None else total

    #: Rows whose distances are taken at once, from all rows that any of them has in its window.
    AT_ONCE = 128

    def steps(self, before: list, after: list, y: list, times: list | None, shares: list | None, then: list | None) -> list:
        before, after, y = np.array(before, float).reshape(-1, len(self.x)), np.array(after, float).reshape(-1, len(self.x)), np.array(y, float)
        times = np.ones(len(before), dtype=int) if times is None else np.array(times, dtype=int)
        held = min(self.n, self.window)
        old = np.arange(self.n - held, self.n) % self.window  # the oldest first
        x, target = np.hstack([self.x[:, old], after.T]), np.append(self.y[old], np.repeat(y, times))
        ends, out = held + np.cumsum(times), []
        now = ends - times
        for i in range(0, len(before), self.AT_ONCE):
            own = slice(i, i + self.AT_ONCE)
            near = self._near(before[own], x, target, now[own])
            if shares is not None:
                shares += [self._shares((None, ys[:n])) for ys, n in zip(near[1].tolist(), near[2].tolist())]
            if then is not None:  # told if asked for, and then for all rows of the block
                later = cache(lambda own=own: self._told(*self._near(after[own], x, target, ends[own])))
                then += [lambda i=j, later=later: later()[i] for j in range(len(before[own]))]
            out += self._told(*near)
        self.n += len(after)
        if self.n > len(self.y):
            size = min(self.window, max(self.n, 2 * len(self.y)))
            self.x, self.y = np.zeros((len(self.x), size)), np.zeros(size)
        kept = min(self.n, self.window)
        places = np.arange(self.n - kept, self.n) % self.window
        self.x[:, places], self.y[places] = x[:, len(target) - kept :], target[len(target) - kept :]
        return out

    def _powers(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The p-th power of the distances of rows from columns of ``x``, summed in the order of the features."""
        total = None
        for own, v in zip(x, rows):
            d = own - v
            d = np.multiply(d, d, out=d) if self.p == 2 else np.abs(d, out=d) if self.p == 1 else np.abs(d) ** self.p
            total = d if total is None else np.add(total, d, out=total)
        return total

    def _close(self, rows: np.ndarray, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, column) with all of the k nearest between ``starts`` and ``ends``, and some more.

        Squared distances come from one product of matrices, whose rounding is allowed for; those that count are taken exactly later.
        """
        slack = 0.0
        if self.p == 2 and len(x) and max(top := float(np.abs(x).max(initial=0.0)), float(np.abs(rows).max(initial=0.0))) < 1e15:
            squares, own = np.einsum("fn,fn->n", x, x), np.einsum("nf,nf->n", rows, rows)
            left = np.column_stack([rows * -2.0, np.ones(len(rows)), own]).astype(np.float32)
            total = left @ np.vstack([x, squares, np.ones(len(squares))]).astype(np.float32)
            slack = np.float32(1e-6 * (len(x) + 4) * (own.max() + squares.max(initial=0.0)) + 1e-30)
        else:
            total = self._powers(rows.T[:, :, None], x[:, None]) if len(x) else np.zeros((len(rows), x.shape[1]))
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            total[i, :a] = total[i, b:] = np.inf
        if total.shape[1] > self.k:
            least = least_of_groups(total)
            place = upto(total, kth_or_more(total, self.k, least) + slack, least)
        else:
            place = np.arange(total.size)
        of, at = np.divmod(place, max(total.shape[1], 1))
        inside = (at >= starts[of]) & (at < ends[of])
        return of[inside], at[inside]

    def _near(self, rows: np.ndarray, x: np.ndarray, target: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and targets of the k nearest of each row in the window up to its place in ``ends``, the nearest first, and how many there are."""
        starts = np.maximum(ends - self.window, 0)
        a, b = int(starts.min()), int(ends.max())
        x, target = x[:, a:b], target[a:b]
        of, at = self._close(rows, x, starts - a, ends - a)
        d = self._powers(rows.T[:, of], x[:, at]) if len(x) else np.zeros(len(of))
        y = target[at]
        order = np.lexsort((y, d, of))  # stable: of equals the oldest
        bounds = np.searchsorted(of, np.arange(len(rows) + 1))
        n = np.minimum(np.diff(bounds), self.k)
        if not len(of):
            return np.zeros((len(rows), 0)), np.zeros((len(rows), 0)), n
        taken = order[np.minimum(bounds[:-1, None] + np.arange(self.k), len(of) - 1)]
        d, y = d[taken], y[taken]
        return np.sqrt(d) if self.p == 2 else d if self.p == 1 else np.array([[v ** (1 / self.p) for v in row] for row in d.tolist()]), y, n

    def predict_all(self, rows: list) -> list:
        """``predict`` of several rows, none of which is learned."""
        held = min(self.n, self.window)
        old = np.arange(self.n - held, self.n) % self.window
        return self._told(*self._near(np.array(rows, float).reshape(-1, len(self.x)), self.x[:, old], self.y[old], np.full(len(rows), held)))

    def nearest(self, x: list[float]) -> tuple[list[float], list[float]]:
        have = min(self.n, self.window)
        d = self._distances(x, have)
        close = np.flatnonzero(d <= np.partition(d, self.k - 1)[self.k - 1]) if have > self.k else np.arange(have)
        near = sorted(zip(d[close].tolist(), self.y[close].tolist(), ((close - self.n) % self.window if self.n > self.window else close).tolist()))[: self.k]
        return [sqrt(v) if self.p == 2 else v ** (1 / self.p) for v, _, _ in near], [y for _, y, _ in near]


class Nearest(_Window):
    """The majority of the k nearest; -1 before any row, ties to the smaller class."""

    @staticmethod
    def _shares(near: tuple[list, list]) -> dict[int, float]:
        own = [int(y) for y in near[1]]
        return {c: own.count(c) / len(own) for c in sorted(set(own))}

    def _said(self, near: tuple[list, list]) -> int:
        p = self._shares(near)
        return max(p, key=p.get) if p else -1  # labels ascend: of equals the smallest

    def _told(self, _, y: np.ndarray, n: np.ndarray) -> list[int]:
        """``_said`` of many rows: of the labels with most places the smallest."""
        if not y.shape[1]:
            return [-1] * len(y)
        there = np.arange(y.shape[1]) < n[:, None]
        places = np.where(there, ((y[:, :, None] == y[:, None, :]) & there[:, None, :]).sum(2), -1)
        best = np.where(places == places.max(1)[:, None], y, np.inf).min(1)
        return np.where(n > 0, best, -1).astype(int).tolist()

    def proba(self, x: np.ndarray) -> dict[int, float]:
        return self._shares(self.nearest(x))

    def predict(self, x: np.ndarray) -> int:
        return self._said(self.nearest(x))


class NearestMean(_Window):
    """The mean of the k nearest, weighted by inverse distance; 0 before any row."""

    def predict(self, x: np.ndarray) -> float:
        return self._said(self.nearest(x))

    def _told(self, d: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[float]:
        """``_said`` of many rows, with the sums in the same order."""
        total, weight = np.zeros(len(y)), np.zeros(len(y))
        for j in range(y.shape[1]):
            with np.errstate(divide="ignore"):
                w = np.where(j < n, np.where(d[:, j] <= 1e-10, 1e10, 1 / d[:, j]), 0.0)
            total += np.where(j < n, w * y[:, j], 0.0)
            weight += w
        return np.divide(total, weight, out=np.zeros(len(y)), where=weight != 0).tolist()

    @staticmethod
    def _said(near: tuple[list, list]) -> float:
        total = weight = 0.0
        for d, y in zip(*near):
            w = 1e10 if d <= 1e-10 else 1 / d
            total += w * y
            weight += w
        return total / weight if weight else 0.0


class Bagged:
    """Online bagging in one state: each member learns a row as often as a Poisson draw of the seed's generator says."""

    plain = True

    def __init__(self, width: int, maker=NaiveBayes, members: int = 5, rate: float = 6.0, seed: int = 0, params: dict | None = None):
        self.members = [made(maker, width, params or {}) for _ in range(members)]
        self.draws, self.rate = np.random.default_rng(seed or 0), rate

    def predict(self, x: list[float]) -> int:
        said = [m.predict(x) for m in self.members]
        return min(set(said), key=lambda c: (-said.count(c), c))

    def learn(self, x: list[float], y: int) -> None:
        for m, times in zip(self.members, self.draws.poisson(self.rate, len(self.members)).tolist()):
            for _ in range(times):
                m.learn(x, y)


def spread(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to and including high: a grid of parameter values."""
    whole = all(float(v).is_integer() for v in (low, high, step))
    n = max(0, int(np.floor((high - low) / step + 1e-9)) + 1)
    return [int(low + i * step) if whole else round(low + i * step, 10) for i in range(n)]
