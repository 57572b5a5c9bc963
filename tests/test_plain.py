"""Learners in plain numbers: equal to the array kernels, and as cheap as they are meant to be."""

import time

import numpy as np
import pytest

from streamtrial.operators import automl, pool
from streamtrial.operators.fold import KERNELS, prequential, run_rows
from streamtrial.operators.pipelines import Config, Pipeline
from streamtrial.operators.plain import PLAIN, Arrays, made


def rows(n, seed=0, classes=True):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 3))
    z = x[:, 0] + 0.5 * x[:, 1] - x[:, 2]
    return x, ((z > 0.2).astype(int) + (z > 0.5) if classes else z + rng.normal(0, 0.1, n))


@pytest.mark.parametrize("maker", list(PLAIN), ids=lambda m: m.__name__)
def test_plain_kernels_equal_the_array_kernels(maker):
    task = next((t for m, t in KERNELS.values() if m is maker), "regression")
    x, y = rows(600, classes=task == "classification")
    params = {"lr": 0.05, "l2": 0.01} if maker.__name__ in ("Logistic", "Softmax", "LinearSgd") else {}
    a, b = maker(3, **params), PLAIN[maker](3, **params)
    got, want = run_rows(b, x, y), run_rows(a, x, y)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    if task == "classification":
        assert a.proba(x[0]).keys() == b.proba(x[0].tolist()).keys() and np.allclose(list(a.proba(x[0]).values()), list(b.proba(x[0].tolist()).values()))


def test_learning_a_row_several_times_at_once_is_the_same():
    x, y = rows(120)
    for scaler in (None, "minmax", "maxabs", "standard"):
        one, other = (Pipeline(Config("naive_bayes", (), scaler), 3) for _ in range(2))
        for i, (row, label) in enumerate(zip(x, y.tolist())):
            assert one.predict(row) == other.predict(row)
            one.learn(row, label, i % 4)
            for _ in range(i % 4):
                other.learn(row, label)


def test_a_learner_from_outside_gets_arrays():
    class Own:
        def __init__(self, width):
            self.got = []

        def predict(self, x):
            return int(x @ x > 1)

        def learn(self, x, y):
            self.got.append(x)

    model = made(Own, 3, {})
    assert isinstance(model, Arrays) and model.predict([1.0, 1.0, 0.0]) == 1
    model.learn([1.0, 2.0, 3.0], 1)
    assert isinstance(model.own.got[0], np.ndarray)


@pytest.mark.parametrize(("model", "classes", "most"), [(lambda: automl.ChampionRegressor(3), False, 30), (lambda: KERNELS["forest_reg"][0](3, models=3), False, 125), (lambda: pool.Bagged(3, members=3), True, 60)], ids=["champion", "forest", "bagged"])
def test_a_row_costs_few_calls_of_numpy(model, classes, most):
    """In calls of ``np.append`` on three numbers, the best of three: 60, 180 and 149 with arrays."""
    x, y = rows(600, classes=classes)
    call = cost = np.inf
    for _ in range(3):
        began = time.perf_counter()
        for row in x:
            for _ in range(10):
                np.append(row, 1.0)
        call, began = min(call, (time.perf_counter() - began) / 10), time.perf_counter()
        run_rows(model(), x, y)
        cost = min(cost, time.perf_counter() - began)
    assert cost / call < most


def test_streams_that_are_folded_alone_equal_the_learner(spark):
    x, y = rows(90, seed=3)
    df = spark.createDataFrame([(f"s{i % 3}", i // 3 + 1, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "stream_id string, seq long, x array<double>, y int").repartition(2)
    got = {(r.stream_id, r.seq): (r.pred, r.proba) for r in prequential(df, "naive_bayes", proba=True).collect()}
    for s in range(3):
        model = KERNELS["naive_bayes"][0](3)
        for i, (row, label) in enumerate(zip(x[s::3].tolist(), y[s::3].tolist())):
            pred, proba = got[f"s{s}", i + 1]
            assert pred == model.predict(row) and proba == model.proba(row)
            model.learn(row, label)


@pytest.mark.parametrize("algo", ["perceptron", "passive_aggressive", "softmax", "bayesian_linear"])
def test_shards_in_plain_numbers_equal_shards_side_by_side(algo, monkeypatch):
    from streamtrial.operators import parameter_mixing

    classes = KERNELS[algo][1] == "classification"
    x, y = rows(900, seed=4, classes=classes)
    ways = []
    for most in (16, 1):
        monkeypatch.setattr(parameter_mixing, "SIDE_BY_SIDE", most)
        means, pred, folded = None, [], []
        monkeypatch.setattr(parameter_mixing, "run_rows", lambda *a, f=folded: f.append(1) or run_rows(*a))
        for at in range(0, 900, 400):
            own = slice(at, at + 400)
            more, states = parameter_mixing.shard_states(algo, {}, means, x[own], y[own], 100, np.unique(y))
            pred, means = pred + more, parameter_mixing.mean_state(states, means)
        ways.append((pred, means, len(folded)))
    assert np.allclose(ways[0][0], ways[1][0], rtol=1e-9) and np.allclose(np.array(ways[0][1]), np.array(ways[1][1]), rtol=1e-9)
    assert ways[0][2] == 9 and ways[1][2] == 1  # the last round has one shard


def test_only_ties_at_the_border_are_looked_at_row_by_row():
    from streamtrial.operators import neighbours

    d = np.array([[3.0, 1.0, 2.0, np.inf], [1.0, 1.0, 1.0, 2.0], [np.inf] * 4, [0.0, 5.0, 5.0, 5.0]])
    taken, more = neighbours._near(d, 2)
    assert more.tolist() == [False, True, False, True] and taken[0].tolist() == [False, True, True, False] and not taken[2].any()
    labels = np.array([2, 1, 1, 0])
    assert neighbours._vote(labels, d, taken).tolist()[0] == 1 and neighbours._vote(labels, d, taken).tolist()[2] == -1
    assert neighbours._weighted(np.array([1.0, 2.0, 4.0, 8.0]), d, taken).tolist()[2] == 0.0
