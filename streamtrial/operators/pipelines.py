"""Pipelines of a scaler, a selector and a learner inside one task, the space of their configurations, and draws from it.

These are the parts of the search strategies in ``automl``: a configuration is a row of names and parameters, a chain is the
running state of its scaler and selector, and learners are the kernels of the fold, in plain numbers where they have that form.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import inf, sqrt

import numpy as np

from streamtrial.operators.dice import Dice
from streamtrial.operators.fold import KERNELS
from streamtrial.operators.plain import made, steps
from streamtrial.operators.pool import spread

# What a search chooses from. Grids of parameters per scaler, selector and learner.
_RATE = spread(0.001, 0.1, 0.005)
_TREE = {"grace": spread(50, 500, 50), "delta": [1e-9, 1e-7, 1e-4, 1e-2], "tie": spread(0.02, 0.08, 0.01)}
_DEPTH = {"depth": spread(10, 100, 10)}
SCALERS = {"classification": {"minmax": {}, "standard": {"with_std": [True, False]}, "maxabs": {}}, "regression": {"minmax": {}, "maxabs": {}}}
SELECTORS = {
    "classification": {"variance": {"threshold": spread(0.0, 1.0, 0.1), "least": spread(1, 10, 1)}, "k_best": {"k": spread(5, 100, 5)}},
    "regression": {"k_best": {"k": spread(2, 25, 1)}},
}
LEARNERS = {
    "classification": {
        "naive_bayes": {},
        "perceptron": {"lr": _RATE},
        "logistic": {"lr": _RATE, "l2": spread(0.0, 0.01, 0.001)},
        "passive_aggressive": {"c": spread(0.1, 10.0, 0.5)},
        "softmax": {"lr": _RATE, "l2": spread(0.0, 0.01, 0.001)},
        "hoeffding_tree": {**_TREE, "nb_threshold": spread(0, 50, 10), **_DEPTH, "criterion": ["info_gain", "gini"]},
        "gradient_tree": {"lr": spread(0.01, 0.5, 0.05), "grace": spread(50, 500, 50), "depth": spread(3, 12, 1)},
        "knn": {"k": spread(3, 15, 2), "window": spread(200, 2000, 200), "p": [1, 2]},
    },
    "regression": {
        "linear": {"lr": _RATE, "l2": spread(0.0, 0.01, 0.001)},
        "bayesian_linear": {"alpha": spread(0.1, 10.0, 0.5), "beta": spread(0.1, 10.0, 0.5)},
        "passive_aggressive_reg": {"c": spread(0.1, 10.0, 0.5), "epsilon": spread(0.0, 0.5, 0.05)},
        "knn_reg": {"k": spread(2, 20, 2), "window": spread(200, 2000, 200), "p": [1, 2]},
        "hoeffding_tree_reg": {**_TREE, **_DEPTH, "lr": _RATE},
        "forest_reg": {"models": spread(3, 9, 2), "depth": spread(5, 30, 5), "grace": spread(50, 500, 50), "combine": ["mean", "median"], "leaf": ["mean", "model", "adaptive"]},
    },
}
#: Values that a parameter has if nothing is said; where the grid lacks one, the grid's first value stands in.
USUAL = {
    "standard": {"with_std": True}, "variance": {"threshold": 0.01, "least": 2}, "k_best": {"k": 10}, "perceptron": {"lr": 0.01}, "logistic": {"lr": 0.01, "l2": 0.0}, "passive_aggressive": {"c": 1.0},
    "softmax": {"lr": 0.01, "l2": 0.0}, "hoeffding_tree": {"grace": 200, "delta": 1e-7, "tie": 0.05, "nb_threshold": 0, "depth": 20, "criterion": "info_gain"}, "gradient_tree": {"lr": 0.1, "grace": 200, "depth": 6},
    "knn": {"k": 5, "window": 1000, "p": 2}, "linear": {"lr": 0.01, "l2": 0.0}, "bayesian_linear": {"alpha": 1.0, "beta": 1.0}, "passive_aggressive_reg": {"c": 1.0, "epsilon": 0.1}, "knn_reg": {"k": 5, "window": 1000, "p": 2},
    "hoeffding_tree_reg": {"grace": 200, "delta": 1e-7, "tie": 0.05, "depth": 20, "lr": 0.01}, "forest_reg": {"models": 10, "depth": None, "grace": 50, "combine": "median", "leaf": "adaptive"},
}
#: Learners with parameters that strategies without a grid draw from, and the scalers they are paired with.
PRESETS = {
    "classification": [
        ("naive_bayes", {}),
        *[("perceptron", {"lr": v}) for v in (0.001, 0.01, 0.05, 0.1)],
        ("logistic", {"lr": 0.001}), ("logistic", {"lr": 0.01}), ("logistic", {"lr": 0.01, "l2": 0.001}), ("logistic", {"lr": 0.05}),
        *[("passive_aggressive", {"c": v}) for v in (0.5, 1.0, 5.0)],
        *[("softmax", {"lr": v}) for v in (0.001, 0.01, 0.05)],
        *[("hoeffding_tree", {"grace": g, "depth": d}) for g, d in ((50, 10), (100, 20), (200, 30), (500, 50))], ("hoeffding_tree", {"grace": 200, "depth": 20, "criterion": "gini"}),
        *[("gradient_tree", {"lr": r, "depth": d}) for r, d in ((0.1, 6), (0.01, 10), (0.05, 8))],
        *[("knn", {"k": k, "window": w}) for k, w in ((3, 500), (5, 1000), (10, 2000))], ("knn", {"k": 5, "window": 500, "p": 1}),
    ],
    "regression": [
        *[("linear", {"lr": v}) for v in (0.001, 0.01, 0.1)], ("linear", {"lr": 0.01, "l2": 0.001}),
        *[("bayesian_linear", {"alpha": a, "beta": b}) for a, b in ((0.1, 1.0), (0.5, 1.0), (1.0, 1.0), (1.0, 0.1))],
        *[("passive_aggressive_reg", {"c": c, "epsilon": e}) for c, e in ((0.1, 0.01), (0.5, 0.05), (1.0, 0.1), (5.0, 0.1))],
        *[("hoeffding_tree_reg", {"grace": g, "depth": d, "lr": r}) for g, d, r in ((50, 10, 0.01), (100, 20, 0.01), (200, 30, 0.01), (500, 50, 0.001))],
        *[("knn_reg", {"k": k, "window": w}) for k, w in ((3, 500), (5, 1000), (10, 2000))], ("knn_reg", {"k": 5, "window": 500, "p": 1}),
    ],
}
PRESET_SCALERS = ("minmax", "standard", "maxabs")


# --- configurations --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Config:
    algo: str
    params: tuple[tuple[str, object], ...] = ()
    scaler: str | None = None
    scaler_params: tuple[tuple[str, object], ...] = ()
    selector: str | None = None
    selector_params: tuple[tuple[str, object], ...] = ()

    @property
    def name(self) -> str:
        said = lambda kind, params: "".join([kind, *([f"({', '.join(f'{k}={v}' for k, v in params)})"] if params else [])])
        steps = [(self.scaler, self.scaler_params), (self.selector, self.selector_params), (self.algo, self.params)]
        return " | ".join(said(k, p) for k, p in steps if k)


def usual(kind: str, grid: dict[str, list]) -> tuple[tuple[str, object], ...]:
    known = USUAL.get(kind, {})
    return tuple((k, known[k] if known.get(k) in v else v[0]) for k, v in grid.items())


def anywhere(grid: dict[str, list], dice: Dice) -> tuple[tuple[str, object], ...]:
    return tuple((k, dice.pick(v)) for k, v in grid.items())


def all_configs(task: str) -> list[Config]:
    """Every scaler with no selector or each of them, and every learner, with their usual values: 72 for classes, 24 for numbers."""
    out = []
    for scaler, grid in SCALERS[task].items():
        for algo, own in LEARNERS[task].items():
            one = Config(algo, usual(algo, own), scaler, usual(scaler, grid))
            out.append(one)
            out += [replace(one, selector=k, selector_params=usual(k, g)) for k, g in SELECTORS[task].items()]
    return out


def random_config(task: str, dice: Dice, random_params: bool = False) -> Config:
    """A learner, a scaler and, with an even chance, a selector; with their usual values, or any of their grids."""
    values = anywhere if random_params else (lambda grid, _: None)
    algo, scaler, selector = (dice.pick(list(t[task])) for t in (LEARNERS, SCALERS, SELECTORS))
    chosen = [values(t[task][k], dice) or usual(k, t[task][k]) for k, t in ((algo, LEARNERS), (scaler, SCALERS), (selector, SELECTORS))]
    one = Config(algo, chosen[0], scaler, chosen[1])
    return replace(one, selector=selector, selector_params=chosen[2]) if dice.random() > 0.5 else one


def preset(task: str, dice: Dice) -> Config:
    algo, params = dice.pick(PRESETS[task])
    return Config(algo, tuple(params.items()), dice.pick(PRESET_SCALERS))


def _near(grid: dict[str, list], params: tuple, dice: Dice) -> tuple:
    """Each value stays, goes one up, one down, or anywhere, with equal chance; ends are kept. A value off the grid goes anywhere unless it stays."""
    out = []
    for name, value in params:
        values, turn = grid[name], dice.pick(("same", "upper", "lower", "any"))
        if turn != "same":
            at = values.index(value) if value in values and turn != "any" else None
            value = dice.pick(values) if at is None else values[min(at + 1, len(values) - 1) if turn == "upper" else max(at - 1, 0)]
        out.append((name, value))
    return tuple(out)


def nearby(config: Config, task: str, dice: Dice) -> Config:
    one = replace(config, params=_near(LEARNERS[task][config.algo], config.params, dice), scaler_params=_near(SCALERS[task].get(config.scaler, {}), config.scaler_params, dice))
    return replace(one, selector_params=_near(SELECTORS[task][config.selector], config.selector_params, dice)) if config.selector else one


def encoded(config: Config, task: str) -> np.ndarray:
    """Parameter values as a vector of fixed length: truth as 1 or 2, numbers as they are, words as place in the grid + 1, then zeros."""
    grids = LEARNERS[task]
    out = np.zeros(max(len(g) for g in grids.values()))
    for i, (k, v) in enumerate(config.params):
        out[i] = (1.0 if v else 2.0) if isinstance(v, bool) else float(v) if isinstance(v, (int, float)) else grids[config.algo][k].index(v) + 1.0
    return out


def mutated(config: Config, task: str, dice: Dice) -> Config:
    """Numbers move by a normal draw (a sixth of the grid's range times 0.7) and are clipped to the range; of words each other one is less likely than the own."""
    out = []
    for k, v in config.params:
        grid = LEARNERS[task][config.algo][k]
        if isinstance(v, bool):
            v = v != (dice.random() < 0.5)
        elif isinstance(v, (int, float)):
            low, high = min(grid), max(grid)
            moved = min(max(dice.normal(v, max((high - low) / 6, 1e-9) * 0.7), low), high)
            v = int(round(moved)) if isinstance(v, int) else float(moved)
        else:
            v = dice.pick(grid, [1.5 if w == v else 1.0 for w in grid])
        out.append((k, v))
    return replace(config, params=tuple(out))


# --- scalers and selectors -------------------------------------------------------------------------------

def running(n: int, mean: list[float], m2: list[float], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and squared deviations (rows + 1 by features) before and after each row, by the recurrence of ``learn``."""
    means, squares = np.empty((len(rows) + 1, len(mean))), np.empty((len(rows) + 1, len(mean)))
    for f, (m, q) in enumerate(zip(mean, m2)):
        ms, qs = [m], [q]
        to_means, to_squares = ms.append, qs.append
        for k, v in enumerate(rows[:, f].tolist(), n + 1):
            d = v - m
            m += d / k
            q += d * (v - m)
            to_means(m)
            to_squares(q)
        means[:, f], squares[:, f] = ms, qs
    return means, squares


class Scaler:
    """Running statistics of x; before any row it gives zeros."""

    def __init__(self, width: int, kind: str, with_std: bool = True):
        self.kind, self.with_std, self.n = kind, with_std, 0
        self.low, self.high = [inf] * width, [-inf] * width
        self.mean, self.m2 = [0.0] * width, [0.0] * width

    def learn(self, x: list[float], y=None) -> None:
        self.n = n = self.n + 1
        if self.kind == "standard":
            mean, m2 = self.mean, self.m2
            for f, v in enumerate(x):
                d = v - mean[f]
                mean[f] = m = mean[f] + d / n
                m2[f] += d * (v - m)
        else:
            low, high = self.low, self.high
            for f, v in enumerate(x):  # NaN stays
                if v < low[f] or v != v:
                    low[f] = v
                if v > high[f] or v != v:
                    high[f] = v

    def block(self, x: np.ndarray, rows: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x`` as it looks when the first ``ahead`` of the ``rows`` are learned, and each of the rows once it is; learns them all."""
        ns = self.n + np.arange(len(rows) + 1)
        if self.kind == "standard":
            means, squares = running(self.n, self.mean, self.m2, rows)
            self.mean, self.m2 = means[-1].tolist(), squares[-1].tolist()
        else:
            low, high = np.minimum.accumulate(np.vstack([self.low, rows])), np.maximum.accumulate(np.vstack([self.high, rows]))
            self.low, self.high = low[-1].tolist(), high[-1].tolist()
        self.n += len(rows)

        def shown(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            n = ns[at][:, None]
            if self.kind == "minmax":
                size = high[at] - low[at]
                out = np.where(size > 0, (x - low[at]) / size, 0.0)
            elif self.kind == "maxabs":
                top = np.maximum(np.abs(low[at]), np.abs(high[at]))
                out = np.where(top > 0, x / top, 0.0)
            elif self.with_std:
                d = np.sqrt(squares[at] / n)
                out = np.where(d > 0, (x - means[at]) / d, 0.0)
            else:
                out = x - means[at]
            return np.where(n > 0, out, 0.0)

        with np.errstate(all="ignore"):
            return shown(x, ahead), shown(rows, np.arange(1, len(rows) + 1))

    def go_on(self, other: Scaler) -> None:
        """From the statistics of another one."""
        self.n, self.low, self.high, self.mean, self.m2 = other.n, other.low.copy(), other.high.copy(), other.mean.copy(), other.m2.copy()

    def __call__(self, x: list[float]) -> list[float]:
        n = self.n
        if not n:
            return [0.0] * len(x)
        if self.kind == "minmax":
            return [(v - a) / (b - a) if b - a > 0 else 0.0 for v, a, b in zip(x, self.low, self.high)]
        if self.kind == "maxabs":
            return [v / top if (top := max(abs(a), abs(b))) > 0 else 0.0 for v, a, b in zip(x, self.low, self.high)]
        if self.with_std:
            return [(v - m) / d if (d := sqrt(q / n)) > 0 else 0.0 for v, m, q in zip(x, self.mean, self.m2)]
        return [v - m for v, m in zip(x, self.mean)]


def _like(x, out: list[float]):
    """Arrays for arrays."""
    return out if isinstance(x, list) else np.array(out)


class VarianceKept:
    """Features whose variance over the rows so far is over ``threshold``, all of them below ``least`` rows; others are 0."""

    def __init__(self, width: int, threshold: float = 0.0, least: int = 2):
        self.threshold, self.least, self.n, self.mean, self.m2 = threshold, least, 0, [0.0] * width, [0.0] * width

    def learn(self, x: list[float], y=None) -> None:
        self.n = n = self.n + 1
        mean, m2 = self.mean, self.m2
        for f, v in enumerate(x):
            d = v - mean[f]
            mean[f] = m = mean[f] + d / n
            m2[f] += d * (v - m)

    def __call__(self, x: list[float]) -> list[float]:
        if self.n < max(self.least, 1):
            return x
        least = self.threshold * self.n
        return _like(x, [v if q > least else 0.0 for v, q in zip(x, self.m2)])


    def block(self, before: np.ndarray, rows: np.ndarray, ahead: np.ndarray, y: list) -> tuple[np.ndarray, np.ndarray]:
        """Both as ``Scaler.block`` gives them, with 0 for what is left out at the time; learns the rows."""
        means, squares = running(self.n, self.mean, self.m2, rows)
        ns = self.n + np.arange(len(rows) + 1)[:, None]
        kept = (squares > self.threshold * ns) | (ns < max(self.least, 1))
        self.mean, self.m2, self.n = means[-1].tolist(), squares[-1].tolist(), self.n + len(rows)
        return np.where(kept[ahead], before, 0.0), np.where(kept[1:], rows, 0.0)


class KBest:
    """The k features with the greatest absolute correlation with y over the rows so far, the first of equals; others are 0."""

    def __init__(self, width: int, k: int = 10):
        self.k, self.n, self.width = k, 0, width
        self.mean, self.mean_y, self.m2, self.m2_y, self.both = np.zeros(width), 0.0, np.zeros(width), 0.0, np.zeros(width)

    def learn(self, x: np.ndarray, y) -> None:
        if self.k >= self.width:
            return
        self.n, x = self.n + 1, np.asarray(x)
        d, e = x - self.mean, float(y) - self.mean_y
        self.mean = self.mean + d / self.n
        self.mean_y += e / self.n
        self.m2 = self.m2 + d * (x - self.mean)
        self.m2_y += e * (float(y) - self.mean_y)
        self.both = self.both + d * (float(y) - self.mean_y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.k >= self.width:
            return x
        v = self.m2 * self.m2_y
        strength = np.round(np.divide(np.abs(self.both), np.sqrt(np.maximum(v, 0)), out=np.zeros(self.width), where=v > 1e-18), 9)
        kept = set(np.argsort(-strength, kind="stable")[: self.k].tolist())
        return _like(x, [v if f in kept else 0.0 for f, v in enumerate(x)])


    def block(self, before: np.ndarray, rows: np.ndarray, ahead: np.ndarray, y: list) -> tuple[np.ndarray, np.ndarray]:
        if self.k >= self.width:
            return before, rows
        seen, after, at = [], [], 0
        for i, row in enumerate(before):
            for view in rows[at : ahead[i]]:  # those of the row before
                self.learn(view, y[i - 1])
                after.append(self(view))
            at = ahead[i]
            seen.append(self(row))
        for view in rows[at:]:
            self.learn(view, y[-1])
            after.append(self(view))
        return np.array(seen).reshape(before.shape), np.array(after).reshape(rows.shape)


_SELECT = {"variance": VarianceKept, "k_best": KBest}


class Chain:
    """A scaler and a selector, either of which may be missing. Learning updates the scaler first, then the selector with the scaled row."""

    def __init__(self, config: Config, width: int):
        self.scaler = Scaler(width, config.scaler, **dict(config.scaler_params)) if config.scaler else None
        self.selector = _SELECT[config.selector](width, **dict(config.selector_params)) if config.selector else None

    @staticmethod
    def key(config: Config) -> tuple:
        return config.scaler, config.scaler_params, config.selector, config.selector_params

    def __call__(self, x) -> list[float]:
        x = x if isinstance(x, list) else np.asarray(x, float).tolist()
        x = self.scaler(x) if self.scaler else x
        return self.selector(x) if self.selector else x

    def learn(self, x, y) -> list[float]:
        """The row as the learner gets it."""
        x = x if isinstance(x, list) else np.asarray(x, float).tolist()
        if self.scaler:
            self.scaler.learn(x)
            x = self.scaler(x)
        if self.selector:
            self.selector.learn(x, y)
            x = self.selector(x)
        return x


    def block(self, x: np.ndarray, y: list, times: np.ndarray | None = None) -> tuple[list, list]:
        """``views`` as lists."""
        before, rows = self.views(x, y, times)
        return before.tolist(), rows.tolist()

    def views(self, x: np.ndarray, y: list, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows as they look before each is learned, and as the learner gets them, each ``times`` times in a row; learns them all."""
        if times is None:
            before = rows = x
            ahead = np.arange(len(x))
        else:
            before, rows, ahead = x, np.repeat(x, times, axis=0), np.cumsum(times) - times
        if self.scaler:
            before, rows = self.scaler.block(before, rows, ahead)
        if self.selector:
            before, rows = self.selector.block(before, rows, ahead, y)
        return before, rows


class Pipeline:
    """Predicts with the statistics so far; learning updates scaler and selector first."""

    def __init__(self, config: Config, width: int, chain: Chain | None = None):
        self.config, self.chain = config, chain or Chain(config, width)
        self.model = made(KERNELS[config.algo][0], width, dict(config.params))

    def predict(self, x):
        return self.model.predict(self.chain(x))

    def proba(self, x) -> dict[int, float]:
        return self.model.proba(self.chain(x))

    def learn(self, x, y, times: int = 1) -> None:
        """The row so many times; it looks the same to the learner each time if neither a selector nor running moments change."""
        if times > 1 and not self.chain.selector and (self.chain.scaler is None or self.chain.scaler.kind != "standard"):
            x = x if isinstance(x, list) else np.asarray(x, float).tolist()
            view, learn = self.chain.learn(x, y), self.model.learn
            for _ in range(times):
                learn(view, y)
            if self.chain.scaler:
                self.chain.scaler.n += times - 1
        else:
            for _ in range(times):
                self.model.learn(self.chain.learn(x, y), y)


    def asked(self, x: np.ndarray, y: list, times: np.ndarray | None = None, shares: list | None = None) -> tuple:
        """The learner and the arguments of ``steps``, rows as arrays, for rows that are learned one after the other, each ``times`` times; its chain is its own."""
        return self.model, *self.chain.views(x, y, times), y, None if times is None else times.tolist(), shares, None

    def steps(self, x: np.ndarray, y: list, times: np.ndarray | None = None, shares: list | None = None) -> list:
        """Predictions for rows as ``asked``."""
        model, before, after, *more = self.asked(x, y, times, shares)
        return steps(model, before.tolist(), after.tolist(), *more)


def pipelines(configs: list[Config], width: int) -> list[Pipeline]:
    """Untrained pipelines that start at the same row: those with equal scaler and selector share their state."""
    chains: dict[tuple, Chain] = {}
    return [Pipeline(c, width, chains.setdefault(Chain.key(c), Chain(c, width))) for c in configs]


class Views:
    """The row as each chain shows it, made once; and after learning, which each chain does once a row."""

    def __init__(self):
        self.x, self.before, self.after, self.preds = None, {}, {}, {}

    def of(self, x, p: Pipeline) -> list[float]:
        if x is not self.x:
            self.x, self.before, self.after, self.preds = x, {}, {}, {}
        if id(p.chain) not in self.before:
            self.before[id(p.chain)] = p.chain(x)
        return self.before[id(p.chain)]

    def said(self, x, p: Pipeline):
        """What a pipeline predicts before the row is learned."""
        if x is self.x and (key := id(p)) in self.preds:
            return self.preds[key]
        out = p.model.predict(self.of(x, p))
        self.preds[id(p)] = out
        return out

    def learned(self, x, y, p: Pipeline) -> list[float]:
        self.of(x, p)
        if id(p.chain) not in self.after:
            self.after[id(p.chain)] = p.chain.learn(x, y)
        return self.after[id(p.chain)]

    def done(self) -> None:
        self.x = None
