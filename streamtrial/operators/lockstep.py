"""The linear learners over many streams at once: the n-th rows of all streams are one step of numpy.

A fold of one stream costs some microseconds a row for calls on a few numbers. Streams don't know of each other, so a step
here does for all streams that have an n-th row what a kernel of ``kernels`` does for one; weights are arrays
(feature, stream, class) or (feature, stream). Clips keep Python's order of comparison, so that NaN goes the same way.
"""

from __future__ import annotations

import copy

import numpy as np

from streamtrial.operators import kernels


def cut(v: np.ndarray, most: float) -> np.ndarray:
    """``min(most, max(-most, v))`` as Python has it: NaN is ``-most``."""
    v = np.where(v > -most, v, -most)
    return np.where(v < most, v, most)


class _Classes:
    def __init__(self, streams: int, width: int, labels: np.ndarray, lr: float = 0.01, l2: float = 0.0, **_):
        self.lr, self.l2, self.labels = lr, l2, np.unique(labels)
        self.w = np.zeros((width + 1, streams, len(self.labels)))
        self.seen = np.zeros((streams, len(self.labels)), dtype=bool)
        self.rows = np.arange(streams)

    def coded(self, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.labels, y)

    def restore(self, means: list[tuple]) -> None:
        """All streams go on from the same weights."""
        for c, f, value, _ in means:
            at = int(np.searchsorted(self.labels, c))
            self.w[f, :, at], self.seen[:, at] = value, True

    def state(self, counts: np.ndarray) -> list[list[tuple]]:
        return [[(int(c), f, float(self.w[f, s, k]), float(n), 0.0) for k, c in enumerate(self.labels) if self.seen[s, k] for f in range(len(self.w))] for s, n in enumerate(counts)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = self.w[:, : len(x)]
        z = w[0] * x[:, :1]
        for f in range(1, x.shape[1]):
            z += w[f] * x[:, f : f + 1]
        z += w[-1]
        return z

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the labels; -1 for those that a stream had not yet."""
        seen = self.seen[: len(x)]
        z = np.where(seen, self.scores(x), -np.inf)
        p = np.exp(z - np.where(seen.any(1), z.max(1), 0.0)[:, None])
        total = p.sum(1, keepdims=True)
        return np.where(seen, p / np.where(total == 0, 1.0, total), -1.0)

    def step(self, x: np.ndarray, own: np.ndarray, learn: bool = True) -> np.ndarray:
        """Predictions for a row of each of the first streams, which is then learned."""
        z, seen, rows = self.scores(x), self.seen[: len(x)], self.rows[: len(x)]
        masked = np.where(seen, z, -np.inf)
        pred = np.where(seen.any(1), self.labels[masked.argmax(1)], 0)
        if learn:
            seen[rows, own] = True
            masked[rows, own] = z[rows, own]
            self.learn(self.w[:, : len(x)], x, own, rows, masked)
        return pred

    def _descend(self, w: np.ndarray, x: np.ndarray, error: np.ndarray) -> None:
        for f in range(x.shape[1]):
            gain = error * x[:, f : f + 1]
            w[f] += self.lr * (gain - self.l2 * w[f] if self.l2 else gain)
        w[-1] += self.lr * error


class Perceptron(_Classes):
    def learn(self, w, x, own, rows, z):
        taken = z.argmax(1)
        at = np.flatnonzero(taken != own)
        if len(at):
            step = self.lr * x[at].T
            w[:-1, at, own[at]] += step
            w[-1, at, own[at]] += self.lr
            w[:-1, at, taken[at]] -= step
            w[-1, at, taken[at]] -= self.lr


class Logistic(_Classes):
    def learn(self, w, x, own, rows, z):
        error = np.where(self.seen[: len(x)], -1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)
        error[rows, own] += 1
        self._descend(w, x, error)


class Softmax(_Classes):
    def learn(self, w, x, own, rows, z):
        p = np.exp(z - z.max(1, keepdims=True))
        error = -p / p.sum(1, keepdims=True)
        error[rows, own] += 1
        self._descend(w, x, error)


class PassiveAggressive(_Classes):
    def __init__(self, streams: int, width: int, labels: np.ndarray, c: float = 1.0, **_):
        super().__init__(streams, width, labels)
        self.c = c

    def learn(self, w, x, own, rows, z):
        margin = z[rows, own]
        z[rows, own] = -np.inf
        rival = np.where(self.seen[: len(x)], z, -np.inf).argmax(1)
        loss = 1 - (margin - z[rows, rival])
        at = np.flatnonzero((loss > 0) & (self.seen[: len(x)].sum(1) > 1))
        if len(at):
            square = x[at, 0] * x[at, 0]
            for f in range(1, x.shape[1]):
                square += x[at, f] * x[at, f]
            size = loss[at] / (2 * (square + 1))
            size = np.where(size < self.c, size, self.c)
            step = size * x[at].T
            w[:-1, at, own[at]] += step
            w[-1, at, own[at]] += size
            w[:-1, at, rival[at]] -= step
            w[-1, at, rival[at]] -= size


class _Line:
    def __init__(self, streams: int, width: int, labels: np.ndarray | None = None, **_):
        self.w = np.zeros((width + 1, streams))

    def coded(self, y: np.ndarray) -> np.ndarray:
        return y

    def restore(self, means: list[tuple]) -> None:
        for _, f, value, _ in means:
            self.w[f] = value

    def state(self, counts: np.ndarray) -> list[list[tuple]]:
        return [[(0, f, float(v), float(n), 0.0) for f, v in enumerate(self.w[:, s])] for s, n in enumerate(counts)]

    def step(self, x: np.ndarray, y: np.ndarray, learn: bool = True) -> np.ndarray:
        w, x = self.w[:, : len(x)], x.T
        pred = w[0] * x[0]
        for f in range(1, len(x)):
            pred += w[f] * x[f]
        pred += w[-1]
        if learn:
            self.learn(w, x, y - pred)
        return pred


class LinearSgd(_Line):
    CLIP = 10.0

    def __init__(self, streams: int, width: int, labels=None, lr: float = 0.01, l2: float = 0.0, **_):
        super().__init__(streams, width)
        self.lr, self.l2 = lr, l2

    def learn(self, w, x, error):
        error = cut(error, self.CLIP)
        gain = np.clip(error * x, -self.CLIP, self.CLIP)
        w[:-1] += self.lr * (gain - self.l2 * w[:-1])
        w[-1] += self.lr * error


class BayesianLinear(_Line):
    CLIP = 10.0

    def __init__(self, streams: int, width: int, labels=None, alpha: float = 1.0, beta: float = 1.0, **_):
        super().__init__(streams, width)
        self.beta, self.precision = beta, np.full((width + 1, streams), float(alpha))
        self.precision[-1] = 0.0
        self.known = self.precision[:, 0].copy()

    def state(self, counts: np.ndarray) -> list[list[tuple]]:
        return [[(0, f, float(v), float(p), float(p - k)) for f, (v, p, k) in enumerate(zip(self.w[:, s], self.precision[:, s], self.known))] for s in range(len(counts))]

    def restore(self, means: list[tuple]) -> None:
        super().restore(means)
        for _, f, _, gained in means:
            self.known[f] += gained
        self.precision[:] = self.known[:, None]

    def learn(self, w, x, error):
        error, p = cut(error, self.CLIP), self.precision[:, : len(error)]
        w[-1] += self.beta * error / (p[-1] + self.beta)
        p[-1] += self.beta
        p[:-1] += self.beta * x * x
        w[:-1] += np.clip(self.beta * x * error / p[:-1], -self.CLIP, self.CLIP)


class PassiveAggressiveLine(_Line):
    def __init__(self, streams: int, width: int, labels=None, c: float = 1.0, epsilon: float = 0.1, **_):
        super().__init__(streams, width)
        self.c, self.epsilon = c, epsilon

    def learn(self, w, x, error):
        square = x[0] * x[0]
        for f in range(1, len(x)):
            square += x[f] * x[f]
        loss = np.abs(error) - self.epsilon
        size = loss / (1 + square)
        step = np.where(loss > 0, np.where(size < self.c, size, self.c) * np.where(error > 0, 1, -1), 0.0)
        w[:-1] += np.where(loss > 0, step * x, 0.0)
        w[-1] += step


#: The kernels that have a form here, by their class; all others are folded one stream after the other.
LOCKSTEP = {
    kernels.Perceptron: Perceptron,
    kernels.Logistic: Logistic,
    kernels.Softmax: Softmax,
    kernels.PassiveAggressive: PassiveAggressive,
    kernels.LinearSgd: LinearSgd,
    kernels.BayesianLinear: BayesianLinear,
    kernels.PassiveAggressiveLine: PassiveAggressiveLine,
}


def _again(model, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """The streams ``at`` learn a row."""
    part = copy.copy(model)
    own = {"w": (slice(None), at), "precision": (slice(None), at), "seen": at}
    for name, place in own.items():
        if hasattr(model, name):
            setattr(part, name, getattr(model, name)[place])
    part.step(x, y)
    for name, place in own.items():
        if hasattr(model, name):
            getattr(model, name)[place] = getattr(part, name)


def run_streams(model, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, times: np.ndarray | None = None, proba: np.ndarray | None = None) -> np.ndarray:
    """Predictions for the rows of streams that lie one after the other, the longest first; each row is predicted, then learned, ``times`` times.

    ``proba``, rows by labels, is filled with the probabilities of the labels that a stream had before a row.
    """
    starts, y = np.concatenate([[0], np.cumsum(lengths)[:-1]]), model.coded(y)
    out = np.empty(len(x), dtype=model.labels.dtype if hasattr(model, "labels") else float)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # streams longer than n
    for n, m in enumerate(active):
        at = starts[:m] + n
        if proba is not None:
            proba[at] = model.proba(x[at])
        out[at] = model.step(x[at], y[at], learn=times is None)
        if times is not None:
            for r in range(times[at].max()):
                some = np.flatnonzero(times[at] > r)
                _again(model, some, x[at[some]], y[at[some]])
    return out


def side_by_side(maker, params: dict, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, times: np.ndarray | None = None, proba: bool = False) -> tuple[np.ndarray, list[dict] | None]:
    """Predictions of streams that lie between ``bounds``, and a dict of probabilities per row if they are wanted."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in order])
    model = LOCKSTEP[maker](len(lengths), x.shape[1], y, **params)
    table = np.empty((len(x), len(model.labels))) if proba else None
    pred = run_streams(model, x[at], y[at], lengths[order], None if times is None else times[at], table)
    back = np.empty_like(at)
    back[at] = np.arange(len(at))
    if not proba:
        return pred[back], None
    labels = model.labels.tolist()
    return pred[back], [{c: p for c, p in zip(labels, row) if p >= 0} for row in table[back].tolist()]
