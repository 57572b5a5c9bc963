"""Learners of many streams together: equal to one stream after the other, and cheaper."""

import sys

import numpy as np
import pytest

from streamtrial.operators import automl, fold, grove, pool
from streamtrial.operators.forest import LEAVES, ForestRegressor
from streamtrial.operators.plain import each_step, steps


def rows(n, width=3, seed=0, classes=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 1, (n, width)), 1)  # with ties
    z = (x[:, 0] + 0.5 * x[:, width // 2] - x[:, -1]) * np.where(np.arange(n) > n // 2, -1, 1)
    return x, ((z > 0.2).astype(int) if classes else z + rng.normal(0, 0.05, n))


def calls(go) -> int:
    n = [0]

    def count(_, event, __):
        n[0] += event == "call"

    sys.setprofile(count)
    try:
        go()
    finally:
        sys.setprofile(None)
    return n[0]


def state(f: ForestRegressor) -> str:
    def tree(n):
        return (n.depth, n.features, n.mean, n.n, n.w, n.b, n.x, n.y, n.bad_mean, n.bad_model) if n.feature is None else (n.feature, n.threshold, tree(n.left), tree(n.right))

    trees = [t and (tree(t.root), t.splits) for t in (*f.trees, *f.behind)]
    return repr([trees, f.dice.state, f.replaced, [(a.rows, a.new, a.levels) for pair in f.told for a in pair]])


@pytest.mark.parametrize("width", [1, 3, 5])
def test_forests_side_by_side_equal_each_alone(width):
    """Of different sizes, lengths and settings, over two blocks, with drift, trees in the background and rows that look otherwise before they are learned."""
    jobs, models, want = [], [], []
    for i in range(20):
        x, y = rows([500, 250, 640, 0, 33][i % 5], width, i)
        params = {"models": [3, 4, 5, 1][i % 4], "grace": [20, 50, 15, 100][i % 4 if i < 12 else 0], "delta": [0.5, 0.01][i % 2], "combine": ["median", "mean"][i // 2 % 2], "leaf": LEAVES[i % 3], "depth": [None, 3, 1][i // 4 % 3], "warning": [0.01, 0.3][i % 2], "seed": i}
        one, other = (ForestRegressor(width, **params) for _ in range(2))
        before, then, told = x + 0.05 * (i % 3), *([[], []] if i % 2 else [None, None])
        k = len(x) // 2
        jobs.append([(one, before[a:b], x[a:b], y[a:b].tolist(), then) for a, b in ((0, k), (k, len(x)))])
        want.append((sum([each_step(other, before[a:b].tolist(), x[a:b].tolist(), y[a:b].tolist(), None, None, told) for a, b in ((0, k), (k, len(x)))], []), told))
        models.append((one, other))
    halves = [grove.forests([j[h] for j in jobs]) for h in range(2)]
    assert [(a + b, j[0][4]) for a, b, j in zip(*halves, jobs)] == want
    assert all(state(a) == state(b) for a, b in models)
    assert sum(a.replaced for a, _ in models) and sum(t.splits for a, _ in models for t in a.trees) > 100


@pytest.mark.parametrize(("algo", "params"), [("adaptive_reg", {"window": 60, "budget": 6}), ("adaptive_reg", {"window": 50, "budget": 5, "mode": "best"}), ("forest_reg", {"models": 3, "grace": 20, "delta": 0.5})])
def test_streams_together_equal_each_alone(algo, params, monkeypatch):
    monkeypatch.setattr(grove, "SIDE_BY_SIDE", 2)
    maker, streams = fold.KERNELS[algo][0], [rows(n, seed=n) for n in (210, 130, 0, 210, 7)]
    one, other = ([maker(3, seed=i, **params) for i in range(len(streams))] for _ in range(2))
    assert grove.together([m.going(x, y) for m, (x, y) in zip(one, streams)]) == [fold.run_rows(m, x, y) for m, (x, y) in zip(other, streams)]
    assert repr([getattr(m, "log", 0) for m in one]) == repr([getattr(m, "log", 0) for m in other])


def test_a_row_of_many_forests_takes_few_calls():
    """Python calls a row of a stream over 40 rows of 150: 57.5 one by one, 8.1 together."""
    made = lambda: [ForestRegressor(3, models=3, seed=i) for i in range(150)]
    data = [rows(40, seed=i) for i in range(150)]
    models = made()
    assert calls(lambda: grove.together([m.going(x, y) for m, (x, y) in zip(models, data)])) / 40 / 150 < 20


def test_streams_of_a_forest_go_together(spark, monkeypatch):
    sizes, plain = [], grove.together
    monkeypatch.setattr(grove, "together", lambda runs: sizes.append(len(runs)) or plain(runs))
    import pyarrow as pa

    x, y = rows(60)
    table = pa.table({"x": x.tolist(), "y": y})
    got = fold.each_alone(table, np.array([0, 20, 45, 60]), lambda at, width: ForestRegressor(width, models=2, seed=at))
    assert sizes == [3]
    assert got == sum([fold.run_rows(ForestRegressor(3, models=2, seed=a), x[a:b], y[a:b]) for a, b in ((0, 20), (20, 45), (45, 60))], [])
    df = spark.createDataFrame([(str(i % 3), i, x[i].tolist(), float(y[i])) for i in range(60)], "stream_id string, seq long, x array<double>, y double")
    assert fold.prequential(df, "forest_reg", {"models": 2}).count() == 60


@pytest.mark.parametrize(("k", "window", "p"), [(5, 300, 2), (15, 700, 2), (3, 40, 1), (4, 50, 3)])
def test_neighbours_by_a_product_of_matrices_are_those_of_each_row(k, window, p):
    x, y = rows(600, classes=True)
    far, odd = x * 1e-6 + 1e3, x.copy()
    odd[100], odd[200:210] = np.nan, 1e200
    for x in (x, x - 0.5, far, odd):
        for maker in (pool.Nearest, pool.NearestMean):
            one, other = (maker(3, k=k, window=window, p=p) for _ in range(2))
            then, told = [], []
            got = steps(one, x.tolist(), x.tolist(), y.tolist(), None, None, then)
            with np.errstate(all="ignore"):
                want = each_step(other, x.tolist(), x.tolist(), y.tolist(), None, None, told)
            assert repr(got) == repr(want) and repr([f() for f in then]) == repr(told)


def test_the_best_after_each_row_is_that_of_the_loop():
    rng = np.random.default_rng(4)
    for _ in range(30):
        now, best = np.round(rng.uniform(0, 1, (6, 33)), 1), int(rng.integers(6))
        want, own = [], best
        for t in range(32):
            top = now[own, t]
            for i, v in enumerate(now[:, t + 1].tolist()):
                if i == own:
                    top = v
                elif v < top:
                    own, top = i, v
            want.append(own)
        assert automl.bests(now, best) == want


def test_members_of_a_holdout_search_share_a_group(spark, monkeypatch):
    """Each member had a group of its own for every stream: 18 groups here, and as many copies of the rows."""
    from streamtrial.plans import search

    x, y = rows(90, classes=True)
    df = spark.createDataFrame([("s" if i < 60 else "t" if i < 87 else "u", i, x[i].tolist(), int(y[i])) for i in range(90)], "stream_id string, seq long, x array<double>, y int")
    board = search.holdout_search(df, budget=6, seed=1)
    assert "Generate" not in board._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.stream_id, r.member): (r.score, r.best) for r in board.collect()}
    assert {s for s, _ in got} == {"s", "t"} and len(got) == 12
    for s, a, b in (("s", 0, 60), ("t", 60, 87)):
        want = []
        for config in search.holdout_configs(6, 1):
            p, split = automl.Pipeline(config, 3), a + int((b - a) * 0.8)
            for i in range(a, split):
                p.learn(x[i], int(y[i]))
            want.append(sum(p.predict(x[i]) == y[i] for i in range(split, b)) / (b - split))
        assert [got[s, m] for m in range(6)] == [(v, m == int(np.argmax(want))) for m, v in enumerate(want)]


def test_splits_of_many_leaves_are_those_of_each():
    """A block scored its leaves one by one, and read the whole tree from lists for every block."""
    from streamtrial.operators import tree_growth, trees

    rng = np.random.default_rng(2)
    n = np.floor(rng.uniform(0, 200, (40, 3))) * (rng.random((40, 3)) > 0.2)
    n[:, 1] += 2
    mean, std = rng.normal(0, 1, (40, 3, 4)) * (n > 0)[..., None], rng.uniform(0, 1, (40, 3, 4)) * (n > 1)[..., None]
    for criterion, delta in (("info_gain", 0.5), ("gini", 0.9), ("info_gain", 1e-7)):
        want = [trees.best_split(a[a > 0], m[a > 0], s[a > 0], 3, delta, 0.05, criterion) for a, m, s in zip(n, mean, std)]
        assert trees.best_splits(n, mean, std, 3, delta, 0.05, criterion) == want
    tree = tree_growth.Tree()
    for _ in range(70):
        leaf = int(rng.choice([i for i, f in enumerate(tree.feature) if f < 0]))
        tree.split(leaf, int(rng.integers(4)), float(rng.random()))
        for own, column in zip(tree.arrays(), (tree.feature, tree.threshold, tree.left, tree.right)):
            assert own[: len(column)].tolist() == column
