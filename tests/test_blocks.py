"""Strategies and learners that take blocks of rows: equal to rows one by one, and cheaper."""

import sys

import numpy as np
import pytest

from streamtrial.operators import automl, pool
from streamtrial.operators.dice import Dice
from streamtrial.operators.fold import KERNELS, run_rows
from streamtrial.operators.pipelines import Chain, Config, all_configs
from streamtrial.operators.plain import each_step, made, steps


def rows(n, width=3, seed=0, classes=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 1, (n, width)), 1)  # with ties
    z = x[:, 0] + 0.5 * x[:, 1] - x[:, -1]
    turn = np.where(np.arange(n) > n // 2, -1, 1)
    return x, (((z > 0.2).astype(int) + (z > 0.5) + turn) % 3 if classes else z * turn + rng.normal(0, 0.05, n))


STRATEGIES = [("adaptive", {"window": 100, "budget": 6}), ("adaptive", {"window": 90, "budget": 5, "mode": "best"}), ("adaptive_reg", {"window": 100, "budget": 6}), ("adaptive_reg", {"window": 70, "budget": 5, "mode": "best"}), ("evolving", {"window": 75, "population": 5}), ("evolving_reg", {"window": 75, "population": 5}), ("genetic", {"window": 60, "population": 6})]


@pytest.mark.parametrize("width", [3, 6])
@pytest.mark.parametrize(("name", "params"), STRATEGIES)
def test_blocks_equal_rows_one_by_one(name, params, width):
    maker, task = KERNELS[name]
    for seed in (1, 2):
        x, y = rows(450, width, seed, task == "classification")
        one, other = maker(width, seed=seed, **params), maker(width, seed=seed, **params)
        assert one.run(x, y) == other.one_by_one(x, y)
        assert repr(one.log) == repr(other.log) and one.dice.state == other.dice.state


def test_a_stream_on_which_a_pipeline_diverges_goes_row_by_row(monkeypatch):
    x, y = rows(300, classes=False)
    x[200:] *= 1e12
    one, other = (automl.AdaptiveRegressor(3, window=100, budget=6) for _ in range(2))
    want, told, slow = other.one_by_one(x, y), [], automl.Strategy.one_by_one
    monkeypatch.setattr(automl.Strategy, "one_by_one", lambda self, x, y: told.append(len(x)) or slow(self, x, y))
    assert one.run(x, y) == want and repr(one.log) == repr(other.log)
    assert told == [300]


@pytest.mark.parametrize("config", [c for t in ("classification", "regression") for c in all_configs(t)], ids=lambda c: c.name)
def test_steps_of_a_learner_equal_predict_and_learn(config):
    classes = KERNELS[config.algo][1] == "classification"
    x, y = rows(150, classes=classes)
    y = y.tolist()
    times = np.random.default_rng(3).poisson(1.5, len(y))
    params = {**dict(config.params), **({"window": 40} if "knn" in config.algo else {})}
    for own in (None, times):
        chains, models = [Chain(config, 3) for _ in range(2)], [made(KERNELS[config.algo][0], 3, params) for _ in range(2)]
        shares = [[], []] if classes else [None, None]
        got, want = [], []
        for a in range(0, len(y), 50):
            t = None if own is None else own[a : a + 50]
            before, after = chains[0].block(x[a : a + 50], y[a : a + 50], t)
            then = [] if t is None else None
            got += steps(models[0], before, after, y[a : a + 50], None if t is None else t.tolist(), shares[0], then)
            for i in range(a, min(a + 50, len(y))):
                seen = chains[1](x[i].tolist())
                views = [chains[1].learn(x[i].tolist(), y[i]) for _ in range(1 if t is None else t[i - a])]
                want += each_step(models[1], [seen], views, [y[i]], [len(views)], shares[1], None)
                if then is not None:
                    v = then[i - a]
                    assert (v() if callable(v) else v) == models[1].predict(views[0])
        assert got == want and shares[0] == shares[1]


def test_selectors_that_leave_features_out_in_blocks():
    x, y = rows(120, 6)
    y = y.tolist()
    times = np.random.default_rng(5).poisson(1.0, len(y))
    for selector in (("k_best", (("k", 2),)), ("variance", (("threshold", 0.09), ("least", 5)))):
        one, other = (Chain(Config("linear", (), "minmax", (), *selector), 6) for _ in range(2))
        before, after = one.block(x, y, times)
        views = []
        for i, row in enumerate(x.tolist()):
            assert other(row) == before[i]
            views += [other.learn(row, y[i]) for _ in range(times[i])]
        assert views == after


def test_nearest_neighbours_of_a_block_are_those_of_each_row():
    x, y = rows(200)
    for p in (1, 2):
        one, other = (pool.Nearest(3, k=3, window=30, p=p) for _ in range(2))
        got = steps(one, x.tolist(), x.tolist(), y.tolist())
        want = each_step(other, x.tolist(), x.tolist(), y.tolist())
        assert got == want and one.nearest([0.5] * 3) == other.nearest([0.5] * 3)


def test_draws_at_once_are_those_one_by_one():
    one, other = Dice("a", 3), Dice("a", 3)
    assert one.poissons(6.0, 500).tolist() == [other.poisson(6.0) for _ in range(500)] and one.state == other.state
    assert len(one.poissons(6.0, 0)) == 0 and one.random() == other.random()


@pytest.mark.parametrize(("name", "most"), [("adaptive", 160), ("evolving", 260), ("genetic", 170), ("evolving_reg", 280)])
def test_a_row_takes_few_calls(name, most):
    """Python calls a row over 1,200: 408, 506, 363 and 565 one by one, and 113, 186, 118 and 197 by blocks."""
    maker, task = KERNELS[name]
    x, y = rows(1200, classes=task == "classification")
    model = maker(3, window=200)
    calls = [0]

    def count(_, event, __):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        run_rows(model, x, y)
    finally:
        sys.setprofile(None)
    assert calls[0] / len(x) < most


@pytest.mark.parametrize(("name", "most"), [("adaptive", 45), ("adaptive_reg", 15)])
def test_pipelines_that_had_the_same_rows_step_once(name, most, monkeypatch):
    """Pipelines that a row of the first window steps: 72 and 24 by their number, and 75 and 24 before."""
    maker, task = KERNELS[name]
    x, y = rows(300, classes=task == "classification")
    stepped = []
    monkeypatch.setattr(automl, "steps", lambda model, before, *more: stepped.append(len(before)) or steps(model, before, *more))
    maker(3, window=300).run(x, y)
    assert sum(stepped) / len(x) < most


@pytest.mark.parametrize(("name", "params"), STRATEGIES[:4])
def test_rows_one_by_one_go_on_from_a_run(name, params):
    maker, task = KERNELS[name]
    x, y = rows(400, 3, 6, task == "classification")
    one, other = (maker(3, seed=2, **params) for _ in range(2))
    assert one.run(x[:230], y[:230]) + one.one_by_one(x[230:], y[230:]) == other.one_by_one(x, y)
    assert repr(one.log) == repr(other.log) and one.dice.state == other.dice.state


@pytest.mark.parametrize("algo", ["perceptron", "logistic", "softmax", "passive_aggressive"])
def test_two_classes_of_three_features_equal_the_learner(algo):
    """Also with labels that are missing at first or come late, rows that aren't learned, and numbers that aren't finite."""
    x, label = rows(300, seed=7)
    two = np.where(label > 0, 9, 5)
    late, odd = two.copy(), x.copy()
    late[:40], late[250:] = 9, np.where(label[250:] > 1, 7, late[250:])
    odd[200:] *= 1e300
    odd[250] = [np.nan, np.inf, -np.inf]
    params = {"lr": 0.05, "l2": 0.01} if algo in ("logistic", "softmax") else {}
    for x, y in ((x, two), (x, late), (odd, two)):
        for times in (None, np.random.default_rng(3).poisson(2.0, len(y))):
            models, shares = [made(KERNELS[algo][0], 3, params) for _ in range(2)], ([], [])
            for a, b in ((0, 130), (130, 300)):
                own = None if times is None else times[a:b]
                before, after = x[a:b].tolist(), (x[a:b] if own is None else np.repeat(x[a:b], own, axis=0)).tolist()
                got, want = (go(m, before, after, y[a:b].tolist(), None if own is None else own.tolist(), s) for go, m, s in zip((steps, each_step), models, shares))
                assert got == want and repr(shares[0]) == repr(shares[1]) and repr(models[0].w) == repr(models[1].w)


def test_members_of_a_population_learn_a_row_in_few_calls():
    """Python calls a row of two classes over 1,200: 192 before, 68 with two classes in one loop."""
    x, y = rows(1200)
    model, calls = automl.EvolvingClassifier(3, window=400, seed=0), [0]

    def count(_, event, __):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        model.run(x, (y > 0).astype(int))
    finally:
        sys.setprofile(None)
    assert calls[0] / len(x) < 90, calls[0] / len(x)


def test_a_bound_for_the_nearest_holds_them_all(monkeypatch):
    """All columns were parted to find the k-th; now the least values of groups are, unless numbers are missing."""
    rng = np.random.default_rng(9)
    for wide in (20, 200, 1003):
        total = np.round(rng.uniform(0, 1, (32, wide)), 2)
        total[0, :], total[1, 5:] = np.inf, np.inf
        bound, want = pool.kth_or_more(total, 5), np.sort(total, axis=1)[:, 4]
        assert (bound >= want).all()
        total[2, ::3] = np.nan
        assert pool.kth_or_more(total, 5)[2] >= np.sort(total[2])[4]
    sizes, part = [], np.partition
    monkeypatch.setattr(pool.np, "partition", lambda v, *a, **k: sizes.append(v.shape[1]) or part(v, *a, **k))
    x, y = rows(640)
    steps(pool.Nearest(3, k=5, window=400), x.tolist(), x.tolist(), y.tolist())
    assert max(sizes) < 200
