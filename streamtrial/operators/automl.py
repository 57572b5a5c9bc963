"""Strategies that search over pipelines while they predict, as kernels of the fold.

Each is a learner like any other, ``predict(x)`` and ``learn(x, y)``, whose state is its pool of pipelines, its
control state and its draws. So a search over many streams, strategies and seeds is one Spark job of groups (stream,
seed), with windows of a fixed number of rows inside each group and nothing on the driver. ``log`` holds what a
strategy did: (row, event, configuration, score).

Between two rows at which a strategy may change its pool the pipelines don't know of each other. So ``run``, which has all rows of a
stream, gives each pipeline the rows of such a block at once (``plain.steps``) and then goes through what they said; the results are
those of ``predict`` and ``learn`` row by row, which live streams use. Adaptive searches step up to a window's end, whatever drift
may come before, and step pipelines once that have had the same rows with the same learner.

Fixed values: windows of 1,000 rows, pools of ten, ensembles of three.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from copy import deepcopy
from math import inf, isfinite, log, sqrt

import numpy as np

from streamtrial.operators.dice import Dice
from streamtrial.operators.drift import Adwin, Eddm
from streamtrial.operators.fold import register
from streamtrial.operators.forest import ForestRegressor
from streamtrial.operators.plain import AdaptiveLine, steps
from streamtrial.operators.pipelines import Config, Pipeline, Scaler, Views, all_configs, encoded, mutated, nearby, pipelines, preset, random_config

#: A prediction in the normalised target beyond this has diverged.
DIVERGED = 1e6
register("forest_reg", ForestRegressor, "regression")


def alone(going: Iterator):
    """The end of one strategy's ``going``: what it asks for is stepped learner by learner."""
    told = None
    while True:
        try:
            jobs = going.send(told)
        except StopIteration as end:
            return end.value
        told, lists = [], {}
        for model, before, after, *more in jobs:
            before, after = (lists.setdefault(id(v), (v, v.tolist()))[1] for v in (before, after))
            told.append(steps(model, before, after, *more))


class Strategy:
    """What all strategies have: a counter of rows, draws of the seed, a log."""

    task, plain = "classification", True

    def __init__(self, width: int, seed: int = 0):
        self.width, self.rows, self.dice, self.log = width, 0, Dice(type(self).__name__, seed), []

    def one_by_one(self, x: np.ndarray, y: np.ndarray) -> list:
        out = []
        for row, label in zip(np.asarray(x, float).tolist(), np.asarray(y).tolist()):
            out.append(self.predict(row))
            self.learn(row, label)
        return out

    def run(self, x: np.ndarray, y: np.ndarray) -> list:
        """Predictions of a stream's rows, each of which is learned before the next."""
        return alone(self.going(x, y))

    def going(self, x: np.ndarray, y: np.ndarray) -> Iterator:
        """``run`` that hands out what its learners are to do, lists of (learner and arguments of ``steps``), and is sent what they say."""
        return self.one_by_one(x, y)
        yield

    def note(self, event: str, config: Config | None = None, score: float = float("nan")) -> None:
        self.log.append((self.rows, event, config.name if config else None, float(score)))


def bests(now: np.ndarray, best: int) -> list[int]:
    """The best member after each row, as a loop over the members that keeps the best until one has less; ``now``: members by rows, before the first row and after each."""
    out: list[int] = []
    while len(out) < now.shape[1] - 1:
        own = now[:, len(out) :]
        turns = np.flatnonzero((own[:best, 1:] < own[best, :-1]).any(0) | (own[best + 1 :, 1:] < own[best, 1:]).any(0))
        out += [best] * (int(turns[0]) if len(turns) else own.shape[1] - 1)
        if len(turns):
            top = own[best, turns[0]]
            for i, v in enumerate(own[:, turns[0] + 1].tolist()):
                if i == best:
                    top = v
                elif v < top:
                    best, top = i, v
            out.append(best)
    return out


class _Ahead:
    """What a pipeline says to the rows from ``start`` on before it learns them, and what it says after."""

    def __init__(self, pipeline: Pipeline, start: int):
        self.pipeline, self.start, self.said, self.then = pipeline, start, [], []

    @property
    def end(self) -> int:
        return self.start + len(self.said)


class _Adaptive(Strategy):
    """The pool, its budget and the reaction to drift, shared by both tasks.

    The first pool holds all combinations; after each window it is the best pipeline, a chain of its neighbours and random ones, all
    untrained. ``random`` of the ``budget - 1`` others are random: half, seven tenths after a fall of the best score, eight
    tenths after drift. Drift also halves the window (200 rows at least) and rebuilds the pool at once; the first
    window without a fall afterwards restores both.
    """

    def __init__(self, width: int, window: int = 1000, budget: int = 10, ensemble: int = 3, mode: str = "ensemble", seed: int = 0):
        super().__init__(width, seed)
        if mode not in ("ensemble", "best"):
            raise ValueError("mode must be 'ensemble' or 'best'")
        self.base = self.window = window
        self.others, self.size, self.mode = budget - 1, ensemble, mode
        self.random = -(-self.others // 2)
        self.drifted, self.previous, self.adwin, self.views = False, None, Adwin(), Views()
        self.pool = pipelines(all_configs(self.task), width)
        self.best = self.dice.pick(range(len(self.pool)))
        self.scores = [[0.0, 0] for _ in self.pool]  # sum and number of what is scored
        self.dead: set[int] = set()

    def going(self, x: np.ndarray, y: np.ndarray) -> Iterator:
        """Predictions of a stream's rows, by blocks at whose last row a window may end or drift may be told."""
        x, y, out = np.asarray(x, float), np.asarray(y).tolist(), []
        target, more = self._targets(y)
        self.ahead = {id(p): _Ahead(p, 0) for p in self._members()} if self.rows else {}  # untrained ones may be twins
        while len(out) < len(y):
            at, left = len(out), self.window - self.rows % self.window
            yield from self._go_ahead(x, target, at, min(len(y), at + left))
            size = min(self.adwin.clock - self.adwin.rows % self.adwin.clock, left, len(y) - at)
            out += self._block(at, y[at : at + size], more)
        models = set()
        for p in {id(p): p for p in self._members()}.values():  # rows that come one by one teach each its own
            p.model = deepcopy(p.model) if id(p.model) in models else p.model
            models.add(id(p.model))
        self.ahead = {}
        return out

    def _members(self) -> list[Pipeline]:
        return [*self.pool, *self.team]

    def _go_ahead(self, x: np.ndarray, target: list, at: int, end: int) -> Iterator:
        """All pipelines step to ``end``. Untrained ones with equal learners have one model between them for as long as their chains show them the same rows."""
        held, models = {}, {}
        for p in self._members():
            if id(p) in held:
                continue
            if (own := self.ahead.get(id(p))) is None:
                own = _Ahead(p, at)
                if not vars(p.model).keys() & {"predict", "learn", "proba"}:
                    p.model = models.setdefault((p.config.algo, p.config.params), p.model)
            held[id(p)] = own
        self.ahead = held
        lacking = [a for a in held.values() if a.end < end]
        views, shown, owners, taken = {}, {}, {}, set()
        for a in lacking:
            p = a.pipeline
            if id(p.chain) not in shown:
                before, after = p.chain.views(x[a.end : end], target[a.end : end])
                key = a.end, before.tobytes(), after.tobytes()
                if key not in views:
                    views[key] = before, after
                shown[id(p.chain)] = views[key]
            key = id(p.model), id(shown[id(p.chain)])
            if key not in owners:
                owners[key] = deepcopy(p.model) if key[0] in taken else p.model
                taken.add(key[0])
            p.model = owners[key]
        jobs = {}
        for a in lacking:
            p = a.pipeline
            if id(p.model) not in jobs:
                jobs[id(p.model)] = p.model, *shown[id(p.chain)], target[a.end : end], None, None, [] if self.task == "regression" else None
        said = (yield list(jobs.values())) if jobs else []
        told = {k: (s, job[6]) for (k, job), s in zip(jobs.items(), said)}
        for a in lacking:
            said, then = told[id(a.pipeline.model)]
            done = at - a.start
            a.start, a.said, a.then = at, a.said[done:] + said if a.said else said, None if then is None else a.then[done:] + then
        self._checked([said for said, _ in told.values()])

    def _checked(self, said: list[list]) -> None:
        pass

    def _told(self, p: Pipeline, at: int, size: int) -> list:
        a = self.ahead[id(p)]
        return a.said[at - a.start : at - a.start + size]

    def _rebuilt(self) -> None:
        best = config = self.pool[self.best].config
        configs = [best]
        for _ in range(self.others - self.random):
            config = nearby(config, self.task, self.dice)
            configs.append(config)
        configs += [random_config(self.task, self.dice) for _ in range(self.random)]
        self.pool = pipelines(configs, self.width)
        self.scores, self.dead = [[0.0, 0] for _ in self.pool], set()
        self.team_scores = [[0.0, 0] for _ in self.team]
        self.best = self._first_best()

    def _on_drift(self) -> None:
        self.drifted, self.window = True, max(200, self.base // 2)
        self.random = int(self.others * 0.8)
        self.note("drift", self.pool[self.best].config, self._score(self.scores[self.best]))
        self._rebuilt()

    def _explored(self) -> None:
        if self.rows % self.window:
            return
        config, now = self.pool[self.best].config, self._score(self.scores[self.best])
        if self._fell(now):
            self.random = int(self.others * 0.7)
            self.note("fall", config, now)
        elif self.drifted and (self.previous is not None or self.task == "classification"):
            self.drifted, self.window, self.random = False, self.base, (self.others + 1) // 2
            self.note("stable", config, now)
        self.previous = now
        self.note("window", config, now)
        if self.mode == "ensemble":
            if len(self.team) >= self.size:
                worst = self._worst()
                del self.team[worst], self.team_scores[worst]
            self.team.append(self._joining())
            self.team_scores.append([0.0, 0])
        self._rebuilt()


class AdaptiveClassifier(_Adaptive):
    """Snapshots of the best pipelines, untrained when they join and learning since, vote with weights by recency."""

    def __init__(self, width: int, seed: int = 0, **options):
        super().__init__(width, seed=seed, **options)
        self.team = [Pipeline(self.pool[self.dice.pick(range(len(self.pool)))].config, width) for _ in range(self.size)] if self.mode == "ensemble" else []
        self.team_scores = [[0.0, 0] for _ in self.team]

    def _first_best(self) -> int:
        return 0

    @staticmethod
    def _score(score: list) -> float:
        return score[0] / score[1] if score[1] else 0.0

    def _fell(self, now: float) -> bool:
        return bool(self.previous) and now < 0.95 * self.previous

    def _worst(self) -> int:
        return int(np.argmin([self._score(s) for s in self.team_scores]))

    def _joining(self) -> Pipeline:
        return Pipeline(self.pool[self.best].config, self.width)

    def predict(self, x: np.ndarray) -> int:
        if self.mode == "best":
            return self._said(x, self.pool[self.best])
        votes: dict[int, float] = {}
        for i, p in enumerate(self.team):
            said = self._said(x, p)
            votes[said] = votes.get(said, 0.0) + (i + 1) / len(self.team)
        return max(votes, key=votes.get) if votes else 0  # of equals the vote of the oldest

    def _said(self, x: np.ndarray, p: Pipeline) -> int:
        return self.views.said(x, p)

    def _targets(self, y: list) -> tuple[list, None]:
        return y, None

    def _block(self, at: int, y: list, _) -> list:
        pool, team = [self._told(p, at, len(y)) for p in self.pool], [self._told(p, at, len(y)) for p in self.team]
        out, drift, n = [], False, len(self.team)
        hits = np.array(pool) == np.array(y)
        sums = np.cumsum(hits, axis=1) + np.array([[s[0]] for s in self.scores])
        now = np.column_stack([[self._score(s) for s in self.scores], sums / (self.scores[0][1] + np.arange(1, len(y) + 1))])
        own = bests(-now, self.best)
        for t, (best, *said) in enumerate(zip([self.best, *own[:-1]], *team)):
            if self.mode == "best":
                out.append(pool[best][t])
            else:
                votes: dict[int, float] = {}
                for i, v in enumerate(said):
                    votes[v] = votes.get(v, 0.0) + (i + 1) / n
                out.append(max(votes, key=votes.get) if votes else 0)
        for best, right in zip([self.best, *own], zip(*hits.tolist())):
            drift = self.adwin.update(float(right[best]))
        for s, total in zip(self.scores, sums[:, -1].tolist()):
            s[0], s[1] = total, s[1] + len(y)
        self.best = own[-1]
        for s, own in zip(self.team_scores, team):
            s[0] += sum(a == b for a, b in zip(own, y))
            s[1] += len(y)
        self.rows += len(y)
        if drift and self.rows > 2 * self.base:
            self._on_drift()
        self._explored()
        return out

    def learn(self, x: np.ndarray, y: int) -> None:
        right = self._said(x, self.pool[self.best]) == y
        top = self._score(self.scores[self.best])
        for i, (s, p) in enumerate(zip(self.scores, self.pool)):
            s[0] += self._said(x, p) == y
            s[1] += 1
            if i == self.best:
                top = s[0] / s[1]
            elif s[0] / s[1] > top:
                self.best, top = i, s[0] / s[1]
        for s, p in zip(self.team_scores, self.team):
            s[0] += self._said(x, p) == y
            s[1] += 1
        for p in (*self.pool, *self.team):
            p.model.learn(self.views.learned(x, y, p), y)
        self.views.done()
        drift = self.adwin.update(float(right))
        self.rows += 1
        if drift and self.rows > 2 * self.base:
            self._on_drift()
        self._explored()


class RunningNorm:
    """Mean and population deviation of the targets so far; 1 below two rows."""

    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    @property
    def std(self) -> float:
        return (self.m2 / self.n) ** 0.5 if self.n >= 2 else 1.0

    def learn(self, y: float) -> None:
        self.n += 1
        d = y - self.mean
        self.mean += d / self.n
        self.m2 += d * (y - self.mean)

    def __call__(self, y: float) -> float:
        return (y - self.mean) / self.std if self.std > 0 else 0.0

    def back(self, z: float) -> float:
        return z * self.std + self.mean


def square(v: float) -> float:
    return v * v  # inf where a power would be an error


def diverged(z: float) -> bool:
    return not abs(z) <= DIVERGED


class _Divergence(Exception):
    """A pipeline diverged inside a block."""


class AdaptiveRegressor(_Adaptive):
    """The same on a normalised target, by root mean squared error; snapshots are the trained pipelines themselves.

    A pipeline whose prediction diverges is dead until the pool is rebuilt. With ``double`` a snapshot that still is in the pool, and the
    best pipeline in mode ``best``, learn a row twice (each with the row as it then is scaled), as the published
    implementation has it; by default once. Drift is told by the squared error of the best, from the first row on.
    """

    task, together = "regression", True

    def __init__(self, width: int, double: bool = False, seed: int = 0, **options):
        super().__init__(width, seed=seed, **options)
        self.made = (width, double, seed), options
        self.double, self.norm = double, RunningNorm()
        self.team = [self.pool[self.dice.pick(range(len(self.pool)))] for _ in range(self.size)] if self.mode == "ensemble" else []
        self.team_scores = [[0.0, 0] for _ in self.team]
        self.chosen = self.pool[self.best]

    def _first_best(self) -> int:
        return self.dice.pick(range(len(self.pool)))

    @staticmethod
    def _score(score: list) -> float:
        return sqrt(score[0] / score[1]) if score[1] else 0.0

    def _fell(self, now: float) -> bool:
        return self.previous is not None and now > 1.1 * self.previous

    def _worst(self) -> int:
        return int(np.argmax([self._score(s) for s in self.team_scores]))

    def _joining(self) -> Pipeline:
        return self.pool[self.best]

    def _said(self, x: np.ndarray, p: Pipeline) -> float:
        return float(self.views.said(x, p))

    def going(self, x: np.ndarray, y: np.ndarray) -> Iterator:
        """By blocks from the first row on; where a pipeline diverges the stream starts anew and goes row by row."""
        if self.rows or self.double:
            return self.one_by_one(x, y)
        try:
            return (yield from super().going(x, y))
        except _Divergence:
            self.__init__(*self.made[0], **self.made[1])
            return self.one_by_one(x, y)

    def _members(self) -> list[Pipeline]:
        return [*self.pool, *self.team, *([self.chosen] if self.mode == "best" else [])]

    def _targets(self, y: list) -> tuple[list, list]:
        """The normalised targets, and mean and deviation before the first and after each."""
        norms, z = [(self.norm.mean, self.norm.std)], []
        for v in y:
            self.norm.learn(float(v))
            norms.append((self.norm.mean, self.norm.std))
            z.append(self.norm(float(v)))
        return z, norms

    @staticmethod
    def _added(score: list, said: list, goal: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
        """The sums of squared errors after each row, which ``score`` goes on from."""
        e = goal - (np.array(said) * std + mean)
        sums = np.cumsum(np.append(score[0], e * e))[1:]
        score[0], score[1] = float(sums[-1]), score[1] + len(said)
        return sums

    def _checked(self, said: list[list]) -> None:
        if any(not (np.abs(np.array(s)) <= DIVERGED).all() for s in said):
            raise _Divergence

    def _block(self, at: int, y: list, norms: list) -> list:
        pool, team = [self._told(p, at, len(y)) for p in self.pool], [self._told(p, at, len(y)) for p in self.team]
        chosen, norms = self._told(self.chosen, at, len(y)) if self.mode == "best" else None, norms[at : at + len(y) + 1]
        norms, goal = np.array(norms), np.array(y, dtype=float)
        (mean, std), n = norms[:-1].T, len(self.team)
        if self.mode == "best":
            out = np.array(chosen) * std + mean
        else:
            out, weight = np.zeros(len(y)), 0.0
            for i, s in enumerate(team):
                out += (i + 1) / n * (np.array(s) * std + mean)
                weight += (i + 1) / n
            out = out / weight if weight else mean
        if self.mode == "best" or weight:
            out = np.minimum(DIVERGED, np.maximum(-DIVERGED, out))
        mean, std = norms[1:].T
        before = [self._score(s) for s in self.scores]
        sums = [self._added(s, own, goal, mean, std) for s, own in zip(self.scores, pool)]
        now = np.column_stack([before, np.sqrt(np.array(sums) / (self.scores[0][1] - len(y) + np.arange(1, len(y) + 1)))])
        for s, own in zip(self.team_scores, team):
            self._added(s, own, goal, mean, std)
        own, ahead = bests(now, self.best), [self.ahead[id(p)] for p in self.pool]
        self.best, drift = own[-1], False
        for t, (best, target, (mean, std)) in enumerate(zip(own, y, norms[1:].tolist())):
            a = ahead[best]
            s = a.then[at + t - a.start]
            s = float(s() if callable(s) else s)
            s = min(DIVERGED, max(-DIVERGED, s)) if isfinite(s) else 0.0
            drift = self.adwin.update(min(square(target - (s * std + mean)), 1e10))
        out = out.tolist()
        self.rows += len(y)
        if drift:
            self.chosen = self.pool[self.best]
            self._on_drift()
        if self.rows % self.window == 0:
            self.chosen = self.pool[self.best]
        self._explored()
        return out

    def predict(self, x: np.ndarray) -> float:
        if self.mode == "best":
            z = self._said(x, self.chosen)
            return self.norm.mean if diverged(z) else min(DIVERGED, max(-DIVERGED, self.norm.back(z)))
        total = weight = 0.0
        for i, p in enumerate(self.team):
            if not diverged(z := self._said(x, p)):
                total += (i + 1) / len(self.team) * self.norm.back(z)
                weight += (i + 1) / len(self.team)
        return min(DIVERGED, max(-DIVERGED, total / weight)) if weight else self.norm.mean

    def learn(self, x: np.ndarray, y: float) -> None:
        self.norm.learn(float(y))
        z = self.norm(float(y))
        learning: list[Pipeline] = []
        for i, p in enumerate(self.pool):
            if i in self.dead:
                continue
            if diverged(said := self._said(x, p)):
                self.dead.add(i)
                continue
            self.scores[i][0] += square(y - self.norm.back(said))
            self.scores[i][1] += 1
            learning.append(p)
            if self._score(self.scores[i]) < self._score(self.scores[self.best]):
                self.best = i
        own = set(map(id, learning))
        for s, p in zip(self.team_scores, self.team):
            if not diverged(said := self._said(x, p)):
                s[0] += square(y - self.norm.back(said))
                s[1] += 1
                if self.double or id(p) not in own:
                    learning.append(p)
                    own.add(id(p))
        if self.mode == "best" and (self.double or id(self.chosen) not in own):
            learning.append(self.chosen)
        for p in learning:
            p.model.learn(self.views.learned(x, z, p), z)
        self.views.done()
        said = self.norm.back(min(DIVERGED, max(-DIVERGED, s))) if isfinite(s := self._said(x, self.pool[self.best])) else self.norm.back(0.0)
        self.views.done()
        drift = self.adwin.update(min(square(y - said), 1e10))
        self.rows += 1
        if drift:
            self.chosen = self.pool[self.best]
            self._on_drift()
        if self.rows % self.window == 0:
            self.chosen = self.pool[self.best]
        self._explored()


class _Evolving(Strategy):
    """Online bagging of a population: each member learns a row as often as a Poisson draw says. Each ``window`` rows the member
    with the worst running score becomes a copy of the best with another scaler or another learner; the learner starts untrained,
    a scaler that is kept goes on."""

    def __init__(self, width: int, window: int = 1000, population: int = 10, rate: float = 6.0, seed: int = 0):
        super().__init__(width, seed)
        self.window, self.rate = window, rate
        self.team = [Pipeline(preset(self.task, self.dice), width) for _ in range(population)]
        self.scores = [[0.0, 0] for _ in self.team]

    def _child(self, parent: Pipeline) -> Pipeline:
        other = preset(self.task, self.dice)
        new = self.dice.pick(("scaler", "learner"))
        config = Config(parent.config.algo, parent.config.params, other.scaler) if new == "scaler" else Config(other.algo, other.params, parent.config.scaler)
        child = Pipeline(config, self.width)
        if new == "learner":
            child.chain.scaler.go_on(parent.chain.scaler)
        return child

    def _mutated(self) -> None:
        fitness = [self._fitness(s) for s in self.scores]
        best, worst = int(np.argmax(fitness)), int(np.argmin(fitness))
        self.team[worst], self.scores[worst] = self._child(self.team[best]), [0.0, 0]
        self.note("mutated", self.team[worst].config, fitness[best])

    def going(self, x: np.ndarray, y: np.ndarray) -> Iterator:
        """Predictions of a stream's rows, by windows: the first row of one is predicted before the mutation."""
        x, y, out = np.asarray(x, float), np.asarray(y).tolist(), []
        while len(out) < len(y):
            at, size = len(out), self.window - self.rows % self.window
            rows, target = x[at : at + size], y[at : at + size]
            first = None
            if self.rows and self.rows % self.window == 0:
                first = [self.predict(rows[0].tolist())]
                self._mutated()
            times = self.dice.poissons(self.rate, len(rows) * len(self.team)).reshape(len(rows), -1)
            shares = [[] if self.task == "classification" else None for _ in self.team]
            said = yield [p.asked(rows, target, own, likely) for p, own, likely in zip(self.team, times.T, shares)]
            for s, own in zip(self.scores, said):
                for a, b in zip(own, target):
                    s[0] += self._gain(a, b)
                s[1] += len(rows)
            votes = [self._vote(v) for v in zip(*(shares if self.task == "classification" else said))]
            out += votes if first is None else [*first, *votes[1:]]
            self.rows += len(rows)
        return out

    def learn(self, x: np.ndarray, y) -> None:
        if self.rows and self.rows % self.window == 0:
            self._mutated()
        for p, s in zip(self.team, self.scores):
            s[0] += self._gain(p.predict(x), y)
            s[1] += 1
            p.learn(x, y, self.dice.poisson(self.rate))
        self.rows += 1


class EvolvingClassifier(_Evolving):
    """Votes by the mean of the members' probabilities; null before there are any."""

    @staticmethod
    def _gain(said: int, y: int) -> float:
        return float(said == y)

    @staticmethod
    def _fitness(score: list) -> float:
        return score[0] / score[1] if score[1] else 0.0

    def predict(self, x: np.ndarray) -> int | None:
        return self._vote([p.proba(x) for p in self.team])

    @staticmethod
    def _vote(shares: list[dict[int, float]]) -> int | None:
        total: dict[int, float] = {}
        for own in shares:
            for c, v in own.items():
                total[c] = total.get(c, 0.0) + v
        return max(total, key=lambda c: (total[c], -c)) if total else None


class EvolvingRegressor(_Evolving):
    """The mean of the members; fitness is minus the mean absolute error."""

    task = "regression"

    @staticmethod
    def _gain(said: float, y: float) -> float:
        return -abs(said - y)

    @staticmethod
    def _fitness(score: list) -> float:
        return score[0] / score[1] if score[1] else 0.0

    def predict(self, x: np.ndarray) -> float:
        return self._vote([p.predict(x) for p in self.team])

    @staticmethod
    def _vote(said: list[float]) -> float:
        return sum(said) / len(said)


class GeneticClassifier(Strategy):
    """A population of learners without scalers; the best by running accuracy predicts.

    Each window a parent, drawn in proportion to accuracy, has a mutant; it takes the place of the worst member if a forest, trained
    on the encoded configurations and accuracies of all windows so far, expects it to do as well.
    """

    def __init__(self, width: int, window: int = 1000, population: int = 10, rate: float = 6.0, seed: int = 0):
        super().__init__(width, seed)
        self.window, self.rate, self.best = window, rate, 0
        self.team = []
        for _ in range(population):
            one = random_config(self.task, self.dice, random_params=True)
            self.team.append(Pipeline(Config(one.algo, one.params), width))
        self.scores = [[0, 0] for _ in self.team]
        self.surrogate = ForestRegressor(len(encoded(self.team[0].config, self.task)), seed=seed)

    @staticmethod
    def _accuracy(score: list) -> float:
        return score[0] / score[1] if score[1] else 0.0

    def predict(self, x: np.ndarray) -> int:
        return self.team[self.best].predict(x)

    def going(self, x: np.ndarray, y: np.ndarray) -> Iterator:
        """Predictions of a stream's rows, by windows."""
        x, y, out = np.asarray(x, float), np.asarray(y).tolist(), []
        while len(out) < len(y):
            at, size = len(out), self.window - self.rows % self.window
            rows, target = x[at : at + size], y[at : at + size]
            times = self.dice.poissons(self.rate, len(rows) * len(self.team)).reshape(len(rows), -1)
            said = yield [p.asked(rows, target, own) for p, own in zip(self.team, times.T)]
            scores = self.scores
            for t, label in enumerate(target):
                out.append(said[self.best][t])
                best, top = self.best, self._accuracy(scores[self.best])
                for i, (own, s) in enumerate(zip(scores, said)):
                    own[0] += s[t] == label
                    own[1] += 1
                    now = own[0] / own[1]
                    if i == best:
                        top = now
                    elif now > top:
                        best, top = i, now
                self.best = best
            self.rows += len(rows)
            if self.rows % self.window == 0:
                self._evolved()
        return out

    def learn(self, x: np.ndarray, y: int) -> None:
        for i, p in enumerate(self.team):
            self.scores[i][0] += p.predict(x) == y
            self.scores[i][1] += 1
            p.learn(x, y, self.dice.poisson(self.rate))
            if self._accuracy(self.scores[i]) > self._accuracy(self.scores[self.best]):
                self.best = i
        self.rows += 1
        if self.rows % self.window == 0:
            self._evolved()

    def _evolved(self) -> None:
        now = [self._accuracy(s) for s in self.scores]
        for p, a in zip(self.team, now):
            self.surrogate.learn(encoded(p.config, self.task), round(100 * a, 2))
        parent = self.dice.pick(self.team, [max(a, 1e-9) for a in now])
        mutant = mutated(parent.config, self.task, self.dice)
        expected, worst = self.surrogate.predict(encoded(mutant, self.task)), int(np.argmin(now))
        taken = expected >= 100 * now[worst]
        self.note("taken" if taken else "refused", mutant, expected / 100)
        if taken:
            del self.team[worst], self.scores[worst]
            self.team.append(Pipeline(mutant, self.width))
            self.scores.append([0, 0])
            self.best = int(np.argmax([self._accuracy(s) for s in self.scores]))


def held_out(x: np.ndarray, y: np.ndarray, configs: list[Config], width: int, share: float = 0.8) -> tuple[list[float], list[Pipeline]]:
    """Accuracies of the configurations on the rows after the first ``share``, from which nothing is learned; and the trained pipelines."""
    split = max(1, int(len(x) * share))
    team, rest, y = pipelines(configs, width), x[split:].tolist(), np.asarray(y).tolist()
    shown, scores = {}, []
    for p in team:
        if (key := id(p.chain)) not in shown:
            after = p.chain.views(np.asarray(x[:split], float), y[:split])[1].tolist()
            shown[key] = after, [p.chain(row) for row in rest]
        after, later = shown[key]
        learn = p.model.learn
        for row, label in zip(after, y):
            learn(row, label)
        every = getattr(p.model, "predict_all", None)
        said = every(later) if every and later else map(p.model.predict, later)
        scores.append(sum(a == b for a, b in zip(said, y[split:])) / len(later) if later else 0.0)
    return scores, team


class OnlineAutoml(Strategy):
    """Null in the warm-up; then the pipeline of a hold-out search over its rows, which goes on learning. Drift of its errors (early drift
    detection) starts a search over the last ``recent`` rows. Without a pipeline, as below four rows, the warm-up goes on."""

    def __init__(self, width: int, warm_up: int = 200, budget: int = 20, recent: int = 500, seed: int = 0):
        super().__init__(width, seed)
        self.warm_up, self.budget = warm_up, budget
        self.held, self.current, self.detector = deque(maxlen=max(recent, warm_up)), None, Eddm()
        self.recent = recent

    def _search(self, rows: list) -> Pipeline | None:
        if len(rows) < 4:
            return None
        configs = [preset(self.task, self.dice) for _ in range(self.budget)]
        scores, team = held_out(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), configs, self.width)
        best = int(np.argmax(scores))  # the first of equals
        self.note("searched", configs[best], scores[best])
        return team[best]

    def predict(self, x: np.ndarray) -> int | None:
        return None if self.current is None else self.current.predict(x)

    def learn(self, x: np.ndarray, y: int) -> None:
        self.held.append((x, y))
        self.rows += 1
        if self.current is None:
            if self.rows >= self.warm_up:
                self.current = self._search(list(self.held)[-self.warm_up :])
            return
        said = self.current.predict(x)
        self.current.learn(x, y)
        if self.detector.update(float(said != y)):
            self.note("drift", self.current.config)
            self.current = self._search(list(self.held)[-self.recent :]) or self.current
            self.detector = Eddm()


class ChampionRegressor(Strategy):
    """Champion and challengers (Wu et al. 2021): linear regressors with adaptive steps that differ in learning rate and in the products of features they use.

    The champion predicts. Its neighbourhood is its set of products with one more of each pair of features, and its set with
    another learning rate (log-uniform). At most ``live`` models learn at a time; a challenger runs for a lease of rows, which doubles each time
    it comes back, and waits behind those with shorter leases. After a row a challenger whose loss (mean absolute
    error, clipped to the range of targets so far) is below the champion's by both confidence bounds is the new champion with a new
    neighbourhood; one that is above by both bounds is out.
    """

    task = "regression"
    LOW, HIGH = 2e-10, 1.0

    class _Model:
        def __init__(self, width: int, lr: float, pairs: tuple[tuple[int, int], ...]):
            self.lr, self.pairs = lr, pairs
            self.model = AdaptiveLine(width + len(pairs), lr=lr)
            self.loss, self.squares, self.n, self.lease, self.left = 0.0, 0.0, 0, 0, 0

        def x(self, x: list[float]) -> list[float]:
            return [*x, *[x[a] * x[b] for a, b in self.pairs]] if self.pairs else x

        @property
        def name(self) -> Config:
            return Config("adaptive_line", (("lr", float(f"{self.lr:.6g}")), ("products", len(self.pairs))), "standard")

    def __init__(self, width: int, live: int = 5, lease: int = 100, lr: float = 0.5, delta: float = 0.1, seed: int = 0):
        super().__init__(width, seed)
        self.live_most, self.lease, self.log_delta = live, lease, log(2 / delta)
        self.scaler, self.low, self.high = Scaler(width, "standard"), inf, -inf
        self.champion = self._Model(width, lr, ())
        self.live: list = []
        self.waiting: list = []
        self._neighbours()

    def _neighbours(self) -> None:
        """The champion's neighbourhood, beside those that still wait."""
        known = {(m.lr, m.pairs) for m in (self.champion, *self.live, *self.waiting)}
        pairs = [(a, b) for a in range(self.width) for b in range(a, self.width) if (a, b) not in self.champion.pairs]
        new = [(self.champion.lr, tuple(sorted({*self.champion.pairs, p}))) for p in pairs]
        for _ in range(self.live_most):
            rate = self.LOW * (self.HIGH / self.LOW) ** self.dice.random()
            new.append((rate, self.champion.pairs))
        for lr, own in new:
            if (lr, own) not in known:
                self.waiting.append(self._Model(self.width, lr, own))

    def _scheduled(self) -> None:
        for m in [m for m in self.live if m.left <= 0]:
            self.live.remove(m)
            self.waiting.append(m)
        while len(self.live) < self.live_most - 1 and self.waiting:
            m = min(self.waiting, key=lambda m: m.lease)  # the longest waiting of equals
            self.waiting.remove(m)
            m.lease = m.left = max(self.lease, 2 * m.lease)
            self.live.append(m)

    def _bounds(self, m) -> tuple[float, float]:
        if m.n < 2:
            return -inf, inf
        mean = m.loss / m.n
        wide = sqrt(2 * max(m.squares / m.n - mean * mean, 0.0) * self.log_delta / m.n) + 3 * (self.high - self.low) * self.log_delta / m.n
        return mean - wide, mean + wide

    def predict(self, x) -> float:
        z = self.scaler(x if isinstance(x, list) else np.asarray(x, float).tolist())
        said = self.champion.model.predict(self.champion.x(z))
        if self.low > self.high:
            return 0.0
        return min(self.high, max(self.low, said)) if isfinite(said) else (self.low + self.high) / 2

    def learn(self, x, y: float) -> None:
        self._scheduled()
        x = x if isinstance(x, list) else np.asarray(x, float).tolist()
        before = self.scaler(x)
        self.scaler.learn(x)
        after = self.scaler(x)
        self.low, self.high = min(self.low, float(y)), max(self.high, float(y))
        for m in (self.champion, *self.live):
            said = m.model.predict(m.x(before))
            loss = abs(y - min(self.high, max(self.low, said))) if isfinite(said) else self.high - self.low
            m.loss += loss
            m.squares += loss * loss
            m.n += 1
            m.left -= 1
            m.model.learn(m.x(after), y)
        self.rows += 1
        low, high = self._bounds(self.champion)
        for m in list(self.live):
            own = self._bounds(m)
            if own[1] < low:
                self.note("promoted", m.name, m.loss / m.n)
                self.live.remove(m)
                self.waiting.append(self.champion)
                self.champion = m
                self._neighbours()
                break
            if own[0] > high:
                self.live.remove(m)  # out for good


STRATEGIES = {
    "adaptive": (AdaptiveClassifier, "classification"), "adaptive_reg": (AdaptiveRegressor, "regression"), "evolving": (EvolvingClassifier, "classification"), "evolving_reg": (EvolvingRegressor, "regression"),
    "genetic": (GeneticClassifier, "classification"), "online": (OnlineAutoml, "classification"), "champion": (ChampionRegressor, "regression"),
}
for _name, (_maker, _task) in STRATEGIES.items():
    register(_name, _maker, _task)
