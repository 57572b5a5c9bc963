"""The linear kernels in plain numbers, for folds that go row by row: with few features a call of numpy costs more than what it computes.

The same recurrences as in ``kernels``, over lists. A class with ``plain`` takes rows as lists of floats (``fold.run_rows`` and
pipelines give them so); sums over features are in their order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import exp, sqrt

import numpy as np

from streamtrial.operators import kernels


def dot(w: list[float], x: list[float]) -> float:
    """The sum over x; a bias behind the weights is left out."""
    z = 0.0
    for a, b in zip(x, w):
        z += a * b
    return z


def clip(v: float, most: float) -> float:
    """NaN stays."""
    return most if v > most else -most if v < -most else v


def moved(w: list[float], step: float, x: list[float]) -> None:
    """Weights and their bias a step along a row."""
    if len(x) == 3:  # as most streams have: no loop
        a, b, c = x
        w[0] += step * a
        w[1] += step * b
        w[2] += step * c
    else:
        for f, v in enumerate(x):
            w[f] += step * v
    w[-1] += step


def each_step(model, before: list, after: list, y: list, times: list | None = None, shares: list | None = None, then: list | None = None) -> list:
    predict, learn, out, at = model.predict, model.learn, [], 0
    for i, (x, label) in enumerate(zip(before, y)):
        out.append(predict(x))
        if shares is not None:
            shares.append(model.proba(x))
        end = at + (1 if times is None else times[i])
        for view in after[at:end]:
            learn(view, label)
        if then is not None:
            then.append(predict(after[i]))
        at = end
    return out


def steps(model, before: list, after: list, y: list, times: list | None = None, shares: list | None = None, then: list | None = None) -> list:
    """Predictions for a block of rows, each of which is learned before the next one: what ``predict`` and ``learn`` row by row give.

    ``before`` holds the rows as they look before each is learned, ``after`` as the learner gets them: each ``times`` times in a row, by
    default once. ``shares`` is filled with the probabilities before each row; ``then`` with what the model says to
    ``after`` once the row is learned, or a call that tells it. A model whose methods were replaced goes row by row.
    """
    own = None if vars(model).keys() & {"predict", "learn", "proba"} else getattr(model, "steps", None)
    return own(before, after, y, times, shares, then) if own else each_step(model, before, after, y, times, shares, then)


class _Classes:
    plain = True

    def __init__(self, width: int, lr: float = 0.01, l2: float = 0.0, **_):
        self.width, self.lr, self.l2 = width, lr, l2
        self.classes: list[int] = []
        self.w: list[list[float]] = []  # a bias behind each class's weights

    def _place(self, y: int) -> int:
        if y not in self.classes:
            at = bisect_left(self.classes, y)
            self.classes.insert(at, y)
            self.w.insert(at, [0.0] * (self.width + 1))
        return self.classes.index(y)

    def restore(self, means: list[tuple]) -> None:
        for c, f, value, _ in means:
            at = self._place(int(c))
            self.w[at][f] = value

    def state(self, rows: int, start: list[tuple] | None = None) -> list[tuple]:
        return [(c, f, float(v), float(rows), 0.0) for c, w in zip(self.classes, self.w) for f, v in enumerate(w)]

    def learn(self, x: list[float], y: int) -> None:
        own = self._place(y)
        self._learned(x, own, self.scores(x))

    def step(self, x: list[float], y: int) -> int:
        """A prediction for a row, which is then learned, from the same scores."""
        if y not in self.classes:
            said = self.predict(x)
            self.learn(x, y)
            return said
        z = self.scores(x)
        said = self.classes[z.index(max(z))]
        self._learned(x, self.classes.index(y), z)
        return said

    def scores(self, x: list[float]) -> list[float]:
        if len(x) == 3:
            a, b, c = x
            return [a * p + b * q + c * r + s for p, q, r, s in self.w]
        out = []
        for w in self.w:
            z = 0.0
            for a, b in zip(x, w):
                z += a * b
            out.append(z + w[-1])
        return out

    def predict(self, x: list[float]) -> int:
        if not self.classes:
            return 0
        z = self.scores(x)
        return self.classes[z.index(max(z))]

    def proba(self, x: list[float]) -> dict[int, float]:
        if not self.classes:
            return {}
        return self._shares(self.scores(x))

    def _shares(self, z: list[float]) -> dict[int, float]:
        top = max(z)
        p = [exp(v - top) for v in z]
        total = sum(p)
        return {c: v / total for c, v in zip(self.classes, p)}

    def steps(self, before: list, after: list, y: list, times: list | None, shares: list | None, then: list | None) -> list:
        if then is not None:
            return each_step(self, before, after, y, times, shares, then)
        out, at, scores, learned, classes = [], 0, self.scores, self._learned, self.classes
        pair = self.width == 3
        for i, (x, label) in enumerate(zip(before, y)):
            if pair and len(classes) == 2:
                if set(y[i:]) <= set(classes):
                    self._pair(before[i:], after[at:], [int(v == classes[1]) for v in y[i:]], None if times is None else times[i:], out, shares)
                    break
                pair = False
            if classes:
                z = scores(x)
                out.append(classes[z.index(max(z))])
                if shares is not None:
                    shares.append(self._shares(z))
            else:
                out.append(0)
                if shares is not None:
                    shares.append({})
            end = at + (1 if times is None else times[i])
            if end > at:
                own = classes.index(label) if label in classes else self._place(label)
                for view in after[at:end]:
                    learned(view, own, scores(view))
                at = end
        return out

    def _pair(self, before: list, after: list, own: list, times: list | None, out: list, shares: list | None) -> None:
        """The rest of ``steps`` for two classes and three features, as most streams have; ``own``: the place of each row's class."""
        (first, second), views, one = self.classes, iter(after), range(1)
        w, learn = (*self.w[0], *self.w[1]), self._learned_pair
        for i, (a, b, c) in enumerate(before):
            p, q, r, s, t, u, v, k = w
            y, z = a * p + b * q + c * r + s, a * t + b * u + c * v + k
            out.append(second if z > y else first)
            if shares is not None:
                shares.append(self._shares([y, z]))
            if n := 1 if times is None else times[i]:
                w = learn(w, views, own[i], one if n == 1 else range(n))
        self.w[0][:], self.w[1][:] = w[:4], w[4:]

    def _descend(self, error: list[float], x: list[float]) -> None:
        lr, l2 = self.lr, self.l2
        if len(x) == 3:
            a, b, c = x
            for w, e in zip(self.w, error):
                p, q, r, s = w
                w[:] = p + lr * (e * a - l2 * p), q + lr * (e * b - l2 * q), r + lr * (e * c - l2 * r), s + lr * e
            return
        for w, e in zip(self.w, error):
            for f, v in enumerate(x):
                w[f] += lr * (e * v - l2 * w[f])
            w[-1] += lr * e


class Perceptron(_Classes):
    def _learned_pair(self, w: tuple, views: Iterator, own: int, times: range) -> tuple:
        """Weights after the next rows of a class, both classes' in a row."""
        p, q, r, s, t, u, v, k = w
        lr = self.lr if own else -self.lr
        for _, (a, b, c) in zip(times, views):
            if (a * t + b * u + c * v + k > a * p + b * q + c * r + s) != own:
                p -= lr * a
                q -= lr * b
                r -= lr * c
                s -= lr
                t += lr * a
                u += lr * b
                v += lr * c
                k += lr
        return p, q, r, s, t, u, v, k

    def _learned(self, x: list[float], own: int, z: list[float]) -> None:
        taken = z.index(max(z))
        if taken != own:
            moved(self.w[own], self.lr, x)
            moved(self.w[taken], -self.lr, x)


class Logistic(_Classes):
    def _learned_pair(self, w: tuple, views: Iterator, own: int, times: range) -> tuple:
        p, q, r, s, t, u, v, k = w
        lr, l2, other = self.lr, self.l2, 1 - own
        for _, (a, b, c) in zip(times, views):
            y, z = a * p + b * q + c * r + s, a * t + b * u + c * v + k
            y = -1 / (1 + exp(-y if -500.0 <= y <= 500.0 else -clip(y, 500.0))) + other
            z = -1 / (1 + exp(-z if -500.0 <= z <= 500.0 else -clip(z, 500.0))) + own
            p, q, r, s = p + lr * (y * a - l2 * p), q + lr * (y * b - l2 * q), r + lr * (y * c - l2 * r), s + lr * y
            t, u, v, k = t + lr * (z * a - l2 * t), u + lr * (z * b - l2 * u), v + lr * (z * c - l2 * v), k + lr * z
        return p, q, r, s, t, u, v, k

    def _learned(self, x: list[float], own: int, z: list[float]) -> None:
        error = [-1 / (1 + exp(-v if -500.0 <= v <= 500.0 else -clip(v, 500.0))) for v in z]
        error[own] += 1
        self._descend(error, x)


class Softmax(_Classes):
    def _learned_pair(self, w: tuple, views: Iterator, own: int, times: range) -> tuple:
        p, q, r, s, t, u, v, k = w
        lr, l2, other = self.lr, self.l2, 1 - own
        for _, (a, b, c) in zip(times, views):
            y, z = a * p + b * q + c * r + s, a * t + b * u + c * v + k
            top = z if z > y else y
            y, z = exp(y - top), exp(z - top)
            total = y + z
            y, z = -y / total + other, -z / total + own
            p, q, r, s = p + lr * (y * a - l2 * p), q + lr * (y * b - l2 * q), r + lr * (y * c - l2 * r), s + lr * y
            t, u, v, k = t + lr * (z * a - l2 * t), u + lr * (z * b - l2 * u), v + lr * (z * c - l2 * v), k + lr * z
        return p, q, r, s, t, u, v, k

    def _learned(self, x: list[float], own: int, z: list[float]) -> None:
        top = max(z)
        p = [exp(v - top) for v in z]
        total = sum(p)
        error = [-v / total for v in p]
        error[own] += 1
        self._descend(error, x)


class PassiveAggressive(_Classes):
    def __init__(self, width: int, c: float = 1.0, **_):
        super().__init__(width)
        self.c = c

    def _learned_pair(self, w: tuple, views: Iterator, own: int, times: range) -> tuple:
        p, q, r, s, t, u, v, k = w
        most = self.c
        for _, (a, b, c) in zip(times, views):
            lead = a * t + b * u + c * v + k - (a * p + b * q + c * r + s)
            loss = 1 - (lead if own else -lead)
            if loss > 0:
                size = min(most, loss / (2 * (a * a + b * b + c * c + 1)))
                size = size if own else -size
                p -= size * a
                q -= size * b
                r -= size * c
                s -= size
                t += size * a
                u += size * b
                v += size * c
                k += size
        return p, q, r, s, t, u, v, k

    def _learned(self, x: list[float], own: int, z: list[float]) -> None:
        if len(self.classes) < 2:
            return
        margin, z[own] = z[own], float("-inf")
        rival = z.index(max(z))
        loss = 1 - (margin - z[rival])
        if loss > 0:
            size = min(self.c, loss / (2 * (dot(x, x) + 1)))
            moved(self.w[own], size, x)
            moved(self.w[rival], -size, x)


class _Line:
    plain = True

    def __init__(self, width: int, **_):
        self.w, self.b = [0.0] * width, 0.0

    def predict(self, x: list[float]) -> float:
        if len(x) == 3:
            a, b, c = x
            p, q, r = self.w
            return a * p + b * q + c * r + self.b
        z = 0.0
        for a, b in zip(x, self.w):
            z += a * b
        return z + self.b

    def learn(self, x: list[float], y: float) -> None:
        self._learned(x, y - self.predict(x))

    def steps(self, before: list, after: list, y: list, times: list | None, shares: list | None, then: list | None) -> list:
        out, at, predict, learned = [], 0, self.predict, self._learned
        for i, (x, target) in enumerate(zip(before, y)):
            out.append(predict(x))
            end = at + (1 if times is None else times[i])
            for view in after[at:end]:
                learned(view, target - predict(view))
            if then is not None:
                then.append(predict(after[i]))
            at = end
        return out

    def step(self, x: list[float], y: float) -> float:
        """A prediction for a row, which is then learned."""
        said = self.predict(x)
        self._learned(x, y - said)
        return said

    def restore(self, means: list[tuple]) -> None:
        for _, f, value, _ in means:
            if f < len(self.w):
                self.w[f] = value
            else:
                self.b = value

    def state(self, rows: int, start: list[tuple] | None = None) -> list[tuple]:
        return [(0, f, float(v), float(rows), 0.0) for f, v in enumerate([*self.w, self.b])]


class LinearSgd(_Line):
    CLIP = kernels.LinearSgd.CLIP

    def __init__(self, width: int, lr: float = 0.01, l2: float = 0.0, **_):
        super().__init__(width)
        self.lr, self.l2 = lr, l2

    def _learned(self, x: list[float], error: float) -> None:
        most, lr, l2, w = self.CLIP, self.lr, self.l2, self.w
        error = min(most, max(-most, error))
        for f, v in enumerate(x):
            g = error * v
            w[f] += lr * ((most if g > most else -most if g < -most else g) - l2 * w[f])
        self.b += lr * error


class AdaptiveLine(_Line):
    CLIP = kernels.AdaptiveLine.CLIP

    def __init__(self, width: int, lr: float = 0.5, **_):
        super().__init__(width)
        self.lr, self.squares, self.square_b = lr, [1e-8] * width, 1e-8

    def _learned(self, x: list[float], error: float) -> None:
        most, lr, w, squares = self.CLIP, self.lr, self.w, self.squares
        error = min(most, max(-most, error))
        for f, v in enumerate(x):
            g = error * v
            squares[f] = s = squares[f] + g * g
            w[f] += lr * g / sqrt(s)
        self.square_b += error * error
        self.b += lr * error / sqrt(self.square_b)


class BayesianLinear(_Line):
    CLIP = kernels.BayesianLinear.CLIP

    def __init__(self, width: int, alpha: float = 1.0, beta: float = 1.0, **_):
        super().__init__(width)
        self.beta, self.precision, self.precision_b = beta, [float(alpha)] * width, 0.0
        self.known = [*self.precision, 0.0]  # what shards of a round have in common

    def state(self, rows: int, start: list[tuple] | None = None) -> list[tuple]:
        now = [*self.precision, self.precision_b]
        return [(0, f, float(v), float(p), float(p - k)) for f, (v, p, k) in enumerate(zip([*self.w, self.b], now, self.known))]

    def restore(self, means: list[tuple]) -> None:
        super().restore(means)
        for _, f, _, gained in means:
            self.known[f] += gained
        self.precision, self.precision_b = self.known[:-1], self.known[-1]

    def _learned(self, x: list[float], error: float) -> None:
        most, beta, w, precision = self.CLIP, self.beta, self.w, self.precision
        error = min(most, max(-most, error))
        self.b += beta * error / (self.precision_b + beta)
        self.precision_b += beta
        for f, v in enumerate(x):
            precision[f] = p = precision[f] + beta * v * v
            w[f] += clip(beta * v * error / p, most)


class PassiveAggressiveLine(_Line):
    def __init__(self, width: int, c: float = 1.0, epsilon: float = 0.1, **_):
        super().__init__(width)
        self.c, self.epsilon = c, epsilon

    def _learned(self, x: list[float], error: float) -> None:
        loss = abs(error) - self.epsilon
        if loss > 0:
            step = min(self.c, loss / (1 + dot(x, x)))
            step = step if error > 0 else -step
            for f, v in enumerate(x):
                self.w[f] += step * v
            self.b += step


#: The kernels that have a form here, by their class.
PLAIN = {
    kernels.Perceptron: Perceptron,
    kernels.Logistic: Logistic,
    kernels.Softmax: Softmax,
    kernels.PassiveAggressive: PassiveAggressive,
    kernels.LinearSgd: LinearSgd,
    kernels.AdaptiveLine: AdaptiveLine,
    kernels.BayesianLinear: BayesianLinear,
    kernels.PassiveAggressiveLine: PassiveAggressiveLine,
}


class Arrays:
    """A learner that was registered from outside: it gets rows as arrays."""

    plain = True

    def __init__(self, model):
        self.own = model

    def predict(self, x: list[float]):
        return self.own.predict(np.array(x))

    def proba(self, x: list[float]) -> dict[int, float]:
        return self.own.proba(np.array(x))

    def learn(self, x: list[float], y) -> None:
        self.own.learn(np.array(x), y)


def made(maker, width: int, params: dict):
    """A learner for rows of plain numbers."""
    model = PLAIN.get(maker, maker)(width, **params)
    return model if getattr(model, "plain", False) else Arrays(model)
