"""Recurrences of the linear learners: each row is one rank-one change of a small weight matrix.

A kernel is made for a number of features and has ``predict(x)`` and ``learn(x, y)``; any class with these
methods can be registered in ``KERNELS`` and then runs in batch and on live streams. Weights have a last column
for the bias. Ties go to the smallest class; classes that no row had yet take no part.

``state`` and ``restore`` are for parameter mixing: the weights as rows (class, feature, value, weight of the value in a
mean, gain in precision), and a kernel that goes on from such means.
"""

from __future__ import annotations

import numpy as np


class _Classes:
    """Scores of the classes seen so far, in ascending order of class."""

    def __init__(self, width: int, lr: float = 0.01, l2: float = 0.0, **_):
        self.width, self.lr, self.l2 = width, lr, l2
        self.classes: list[int] = []
        self.w = np.zeros((0, width + 1))

    def _place(self, y: int) -> int:
        if y not in self.classes:
            at = int(np.searchsorted(self.classes, y))
            self.classes.insert(at, y)
            self.w = np.insert(self.w, at, 0.0, axis=0)
        return self.classes.index(y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.w[:, :-1] @ x + self.w[:, -1]

    def predict(self, x: np.ndarray) -> int:
        return self.classes[int(np.argmax(self.scores(x)))] if self.classes else 0

    def proba(self, x: np.ndarray) -> dict[int, float]:
        if not self.classes:
            return {}
        z = self.scores(x)
        p = np.exp(z - z.max())
        return dict(zip(self.classes, (p / p.sum()).tolist()))

    def state(self, rows: int, start: list[tuple] | None = None) -> list[tuple]:
        return [(c, f, float(v), float(rows), 0.0) for c, w in zip(self.classes, self.w) for f, v in enumerate(w)]

    def restore(self, means: list[tuple]) -> None:
        for c, f, value, _ in means:
            at = self._place(int(c))
            self.w[at, f] = value

    def _descend(self, error: np.ndarray, x: np.ndarray) -> None:
        self.w[:, :-1] += self.lr * (np.outer(error, x) - self.l2 * self.w[:, :-1])
        self.w[:, -1] += self.lr * error


class Perceptron(_Classes):
    def learn(self, x: np.ndarray, y: int) -> None:
        own = self._place(y)
        taken = int(np.argmax(self.scores(x)))
        if taken != own:
            step = self.lr * np.append(x, 1.0)
            self.w[own] += step
            self.w[taken] -= step


class Logistic(_Classes):
    """One against the rest."""

    def learn(self, x: np.ndarray, y: int) -> None:
        own = self._place(y)
        error = -1 / (1 + np.exp(-np.clip(self.scores(x), -500, 500)))
        error[own] += 1
        self._descend(error, x)


class Softmax(_Classes):
    def learn(self, x: np.ndarray, y: int) -> None:
        own = self._place(y)
        z = self.scores(x)
        p = np.exp(z - z.max())
        error = -p / p.sum()
        error[own] += 1
        self._descend(error, x)


class PassiveAggressive(_Classes):
    def __init__(self, width: int, c: float = 1.0, **_):
        super().__init__(width)
        self.c = c

    def learn(self, x: np.ndarray, y: int) -> None:
        own = self._place(y)
        if len(self.classes) < 2:
            return
        z = self.scores(x)
        margin, z[own] = z[own], -np.inf
        rival = int(np.argmax(z))
        loss = max(0.0, 1 - (margin - z[rival]))
        if loss:
            step = min(self.c, loss / (2 * (x @ x + 1))) * np.append(x, 1.0)
            self.w[own] += step
            self.w[rival] -= step


class _Line:
    def __init__(self, width: int, **_):
        self.w, self.b = np.zeros(width), 0.0

    def predict(self, x: np.ndarray) -> float:
        return float(self.w @ x + self.b)

    def state(self, rows: int, start: list[tuple] | None = None) -> list[tuple]:
        return [(0, f, float(v), float(rows), 0.0) for f, v in enumerate(np.append(self.w, self.b))]

    def restore(self, means: list[tuple]) -> None:
        for _, f, value, _ in means:
            if f < len(self.w):
                self.w[f] = value
            else:
                self.b = value


class LinearSgd(_Line):
    CLIP = 10.0

    def __init__(self, width: int, lr: float = 0.01, l2: float = 0.0, **_):
        super().__init__(width)
        self.lr, self.l2 = lr, l2

    def learn(self, x: np.ndarray, y: float) -> None:
        error = min(self.CLIP, max(-self.CLIP, y - self.predict(x)))
        self.w += self.lr * (np.clip(error * x, -self.CLIP, self.CLIP) - self.l2 * self.w)
        self.b += self.lr * error


class AdaptiveLine(_Line):
    """Least squares with a step of its own per weight: the rate over the root of the squared gradients so far (Duchi et al. 2011)."""

    CLIP = 1e3

    def __init__(self, width: int, lr: float = 0.5, **_):
        super().__init__(width)
        self.lr, self.squares = lr, np.full(width + 1, 1e-8)

    def learn(self, x: np.ndarray, y: float) -> None:
        error = min(self.CLIP, max(-self.CLIP, y - self.predict(x)))
        gradient = error * np.append(x, 1.0)
        self.squares = self.squares + gradient * gradient
        step = self.lr * gradient / np.sqrt(self.squares)
        self.w = self.w + step[:-1]
        self.b += step[-1]


class BayesianLinear(_Line):
    """Diagonal posterior; the bias starts without a prior."""

    CLIP = 10.0

    def __init__(self, width: int, alpha: float = 1.0, beta: float = 1.0, **_):
        super().__init__(width)
        self.beta, self.precision, self.precision_b = beta, np.full(width, alpha), 0.0
        self.known = np.append(self.precision, 0.0)  # what shards of a round have in common

    def state(self, rows: int, start: list[tuple] | None = None) -> list[tuple]:
        """Means weigh by precision, and precisions add up: the product of the shards' posteriors."""
        now = np.append(self.precision, self.precision_b)
        return [(0, f, float(v), float(p), float(g)) for f, (v, p, g) in enumerate(zip(np.append(self.w, self.b), now, now - self.known))]

    def restore(self, means: list[tuple]) -> None:
        super().restore(means)
        for _, f, _, gained in means:
            self.known[f] += gained
        self.precision, self.precision_b = self.known[:-1].copy(), float(self.known[-1])

    def learn(self, x: np.ndarray, y: float) -> None:
        error = min(self.CLIP, max(-self.CLIP, y - self.predict(x)))
        self.b += self.beta * error / (self.precision_b + self.beta)
        self.precision_b += self.beta
        self.precision = self.precision + self.beta * x * x
        self.w = self.w + np.clip(self.beta * x * error / self.precision, -self.CLIP, self.CLIP)


class PassiveAggressiveLine(_Line):
    def __init__(self, width: int, c: float = 1.0, epsilon: float = 0.1, **_):
        super().__init__(width)
        self.c, self.epsilon = c, epsilon

    def learn(self, x: np.ndarray, y: float) -> None:
        error = y - self.predict(x)
        loss = max(0.0, abs(error) - self.epsilon)
        if loss:
            step = min(self.c, loss / (1 + x @ x)) * (1 if error > 0 else -1)
            self.w += step * x
            self.b += step
