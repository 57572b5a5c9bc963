"""The forest's shortcuts: equal to rows one by one, and cheaper."""

import sys

import numpy as np

from streamtrial.operators.drift import Adwin
from streamtrial.operators.fold import run_rows
from streamtrial.operators.forest import ForestRegressor


def rows(n):
    rng = np.random.default_rng(0)
    x = np.round(rng.uniform(0, 1, (n, 3)), 1)
    turn = np.where(np.arange(n) > n // 2, -1, 1)
    return x, (x[:, 0] + 0.5 * x[:, 1] - x[:, 2]) * turn + rng.normal(0, 0.05, n)


def test_values_that_wait_for_the_next_test_of_adwin():
    class Plain(Adwin):
        def update(self, value):
            self.new.append((value, 0.0))
            self._settled()
            self.rows += 1
            return self.rows % self.clock == 0 and self._cut()

    rng, one, other = np.random.default_rng(1), Adwin(), Plain()
    for i, v in enumerate((rng.random(3000) < np.where(np.arange(3000) > 1500, 0.7, 0.2)).astype(float).tolist()):
        assert one.update(v) == other.update(v)
        if i % 37 == 0:
            assert one.width == other.width and one.levels == other.levels


def test_a_forest_learns_a_row_several_times_as_one_by_one(monkeypatch):
    x, y = rows(700)
    one, other = (ForestRegressor(3, models=3, grace=20, delta=0.5) for _ in range(2))
    got = run_rows(one, x, y)
    monkeypatch.setattr("streamtrial.operators.forest.Tree.calm", lambda *_: False)
    assert got == run_rows(other, x, y) and sum(t.splits for t in one.trees) and one.dice.state == other.dice.state


def test_a_row_of_the_forest_takes_few_calls():
    """Python calls a row over 1,200: 99.5 when each repetition was a call."""
    x, y = rows(1200)
    calls, model = [0], ForestRegressor(3, models=3)

    def count(_, event, __):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        run_rows(model, x, y)
    finally:
        sys.setprofile(None)
    assert calls[0] / len(x) < 92


def test_a_forest_of_means_asks_for_no_models():
    """Leaves that predict means learned linear models that nothing asked for; predictions are those of the recurrence of means."""
    from streamtrial.operators.forest import Tree

    x, y = rows(300)
    model = ForestRegressor(3, models=3, leaf="mean", grace=20, delta=0.5)
    seen, own = [], Tree._learned

    def learned(self, node, row, target, times):
        n, mean, bad = node.n, node.mean, node.bad_model
        own(self, node, row, target, times)
        for _ in range(times):
            n += 1
            mean += (target - mean) / n
        seen.append((n, mean) == (node.n, node.mean) and node.bad_model == bad)

    Tree._learned = learned
    try:
        run_rows(model, x, y)
    finally:
        Tree._learned = own
    assert len(seen) > 300 and all(seen) and sum(t.splits for t in model.trees)
