"""Searches, forests and trees against plain loops, and their pinned semantics."""

import copy
import math

import numpy as np
import pytest

from streamtrial.operators import automl, forest, pipelines, tree_growth, trees
from streamtrial.operators.dice import Dice
from streamtrial.operators.drift import Adwin, Eddm
from streamtrial.operators.fold import KERNELS, prequential, run_rows
from streamtrial.operators.pipelines import Chain, Config, Pipeline, all_configs, nearby, preset, random_config
from streamtrial.plans import search


def flipping(n, seed=1, classes=True, width=3):
    """Rows whose rule turns round half-way."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, width))
    rule = x[:, 0] + x[:, 1] > 1
    y = np.where(np.arange(n) * 2 >= n, ~rule, rule).astype(int)
    return x, y if classes else x @ np.arange(1, width + 1) + 3.0


# --- the space -------------------------------------------------------------------------------------------

def test_space_has_all_combinations(spark):
    for task, n in (("classification", 72), ("regression", 24)):
        configs = all_configs(task)
        assert len(configs) == len(set(configs)) == n
        space = search.space_table(spark, task).cache()
        rows = {(r.scaler, r.selector, r.learner) for r in search.combinations(space).collect()}
        assert rows == {(c.scaler, c.selector, c.algo) for c in configs}
        grids = {**pipelines.LEARNERS[task], **pipelines.SCALERS[task], **pipelines.SELECTORS[task]}
        assert space.where("param is not null").count() == sum(len(v) for g in grids.values() for v in g.values())
        assert space.where("usual").count() == sum(len(g) for g in grids.values())
        assert len(pipelines.PRESETS[task]) == {"classification": 27, "regression": 20}[task]


def test_neighbours_as_a_join(spark):
    space = search.space_table(spark, "classification").cache()
    config = space.where("name = 'knn' and usual").select("name", "param", "ord")
    got = {(r.param, r.turn): r.to_value for r in search.neighbours(config, space).collect()}
    assert got["k", "same"] == "5" and got["k", "upper"] == "7" and got["k", "lower"] == "3"
    assert got["p", "upper"] == "2" and got["p", "lower"] == "1" and len(got) == 9


def test_neighbours_stay_on_the_grid():
    dice = Dice("a", 1)
    for task in ("classification", "regression"):
        for _ in range(200):
            config = random_config(task, dice, random_params=True)
            near = nearby(config, task, dice)
            assert (near.algo, near.scaler, near.selector) == (config.algo, config.scaler, config.selector)
            assert all(v in pipelines.LEARNERS[task][near.algo][k] for k, v in near.params)
            moved = pipelines.mutated(Config(config.algo, config.params), task, dice)
            for k, v in moved.params:
                grid = pipelines.LEARNERS[task][config.algo][k]
                assert v in grid if isinstance(v, str) else min(grid) <= v <= max(grid)
            assert len(pipelines.encoded(moved, task)) == max(map(len, pipelines.LEARNERS[task].values()))


def test_draws_are_fair_and_repeat():
    dice = Dice("x", 7)
    u = [dice.random() for _ in range(4000)]
    assert abs(np.mean(u) - 0.5) < 0.02 and abs(np.var(u) - 1 / 12) < 0.01
    k = [dice.poisson(6.0) for _ in range(4000)]
    assert abs(np.mean(k) - 6) < 0.2 and abs(np.var(k) - 6) < 0.5
    z = [dice.normal(2.0, 3.0) for _ in range(4000)]
    assert abs(np.mean(z) - 2) < 0.2 and abs(np.std(z) - 3) < 0.2
    assert [Dice("x", 7).random() for _ in range(2)] == u[:1] * 2 and Dice("x", 8).random() != u[0]


def test_selectors_equal_the_scans(spark):
    from streamtrial.operators import scaling

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(80, 4)) * [1, 0.1, 2, 1], 3)
    y = (x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([("s", i + 1, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "stream_id string, seq long, x array<double>, y int").cache()
    kept = {r.seq: [r.k0, r.k1, r.k2, r.k3] for r in scaling.variance_kept(df, 4, 0.5, 5).collect()}
    best = {r.seq: list(r.best) for r in scaling.k_best(df, 4, 2).collect()}
    variance, k_best = pipelines.VarianceKept(4, 0.5, 5), pipelines.KBest(4, 2)
    for i, row in enumerate(x):
        assert (variance(row) != 0).tolist() == [bool(k) and v != 0 for k, v in zip(kept[i + 1], row)]
        if i > 5:
            assert np.flatnonzero(k_best(row)).tolist() == [f for f in best[i + 1] if row[f]]
        variance.learn(row)
        k_best.learn(row, y[i])


# --- strategies ------------------------------------------------------------------------------------------

class PlainAdaptive:
    """The adaptive classifier by its rules, each pipeline with a scaler and selector of its own."""

    def __init__(self, width, window, budget, size, seed):
        self.width, self.base, self.window, self.others, self.size = width, window, window, budget - 1, size
        self.dice, self.random = Dice("AdaptiveClassifier", seed), math.ceil((budget - 1) / 2)
        self.fresh(all_configs("classification"))
        self.best = self.dice.pick(range(len(self.pool)))
        self.team = [Pipeline(self.pool[self.dice.pick(range(len(self.pool)))].config, width) for _ in range(size)]
        self.team_hits = [[] for _ in self.team]
        self.rows, self.previous, self.drifted, self.adwin, self.events = 0, 0.0, False, Adwin(), []

    def fresh(self, configs):
        self.pool = [Pipeline(c, self.width, Chain(c, self.width)) for c in configs]
        self.hits, self.best = [[] for _ in configs], 0

    def next_pool(self):
        configs = [self.pool[self.best].config]
        for _ in range(self.others - self.random):
            configs.append(nearby(configs[-1], "classification", self.dice))
        configs += [random_config("classification", self.dice) for _ in range(self.random)]
        self.fresh(configs)
        self.team_hits = [[] for _ in self.team]

    def predict(self, x):
        said = [p.predict(x) for p in self.team]
        weight = {c: sum(i + 1 for i, v in enumerate(said) if v == c) for c in said}
        return next(c for c in said if weight[c] == max(weight.values()))

    def learn(self, x, y):
        accuracy = lambda h: sum(h) / len(h) if h else 0.0
        right = self.pool[self.best].predict(x) == y
        for i, p in enumerate(self.pool):
            self.hits[i].append(p.predict(x) == y)
            p.learn(x, y)
            if accuracy(self.hits[i]) > accuracy(self.hits[self.best]):
                self.best = i
        for h, p in zip(self.team_hits, self.team):
            h.append(p.predict(x) == y)
            p.learn(x, y)
        self.rows += 1
        if self.adwin.update(float(right)) and self.rows > 2 * self.base:
            self.drifted, self.window, self.random = True, max(200, self.base // 2), int(0.8 * self.others)
            self.events.append((self.rows, "drift"))
            self.next_pool()
        if self.rows % self.window == 0:
            now = accuracy(self.hits[self.best])
            if self.previous > 0 and now < 0.95 * self.previous:
                self.random = int(0.7 * self.others)
                self.events.append((self.rows, "fall"))
            elif self.drifted:
                self.drifted, self.window, self.random = False, self.base, (self.others + 1) // 2
                self.events.append((self.rows, "stable"))
            self.previous = now
            self.events.append((self.rows, "window"))
            worst = min(range(len(self.team)), key=lambda i: accuracy(self.team_hits[i]))
            self.team = [p for i, p in enumerate(self.team) if i != worst] + [Pipeline(self.pool[self.best].config, self.width)]
            self.next_pool()


def test_adaptive_search_equals_a_plain_loop(spark):
    x, y = flipping(1000)
    plain, want = PlainAdaptive(3, 200, 6, 3, 5), []
    for row, label in zip(x, y):
        want.append(plain.predict(row))
        plain.learn(row, label)
    df = spark.createDataFrame([("s", i + 1, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "stream_id string, seq long, x array<double>, y int").repartition(3)
    options = {"window": 200, "budget": 6}
    got = [r.pred for r in search.searched(df, "adaptive", options, seeds=(5,)).orderBy("seq").collect()]
    assert got == want
    log = [(r.seq, r.event) for r in search.search_log(df, "adaptive", options, seeds=(5,)).collect()]
    assert log == plain.events
    drift = next(s for s, e in log if e == "drift")
    assert 500 < drift < 700 and (drift, "drift") in log and any(s > drift and e in ("fall", "stable") for s, e in log)


def test_drift_control_state():
    """Drift halves the window and rebuilds at once; it is ignored for two windows; a stable window restores."""
    model = automl.AdaptiveClassifier(3, window=600, budget=11)
    assert (model.window, model.random) == (600, 5) and len(model.pool) == 72
    model.rows = 600
    pool = model.pool
    model._on_drift()
    assert (model.window, model.random, len(model.pool)) == (300, 8, 11) and model.pool is not pool and model.best == 0
    model.scores[0], model.previous = [80, 100], 0.8
    model._explored()
    assert (model.window, model.random, model.drifted) == (600, 5, False)
    model.rows, model.scores[0] = 1200, [50, 100]
    model._explored()
    assert model.random == 7 and model.log[-2][1] == "fall"
    told = automl.AdaptiveClassifier(3, window=100, budget=3)
    told.adwin.update = lambda _: True
    for i in range(201):
        told.learn(np.ones(3) * i, 0)
        assert [e for _, e, *_ in told.log if e == "drift"] == [] or i == 200
    assert told.log[-1][1] == "drift" and told.window == 200


def test_snapshots_are_no_members_of_the_pool():
    model = automl.AdaptiveClassifier(3)
    assert not {id(p) for p in model.pool} & {id(p) for p in model.team} and len(model.team) == 3
    best = automl.AdaptiveClassifier(3, mode="best", window=5, budget=4)
    for row, label in zip(*flipping(5)):
        best.learn(row, label)
    assert best.best == 0 and len(best.pool) == 4 and not best.team
    with pytest.raises(ValueError):
        automl.AdaptiveClassifier(3, mode="all")


@pytest.mark.parametrize("double", [False, True])
def test_regression_snapshots_learn_once_or_twice(double):
    model = automl.AdaptiveRegressor(3, double=double, seed=3)
    x, y = flipping(30, classes=False)
    counts = {}
    for p in model.pool:
        def learn(*a, own=p.model, key=id(p)):
            counts[key] = counts.get(key, 0) + 1
            return type(own).learn(own, *a)

        p.model.learn = learn
    run_rows(model, x, y)
    team = [id(p) for p in model.team]
    assert set(team) <= {id(p) for p in model.pool}
    for p in model.pool:
        assert counts[id(p)] == 30 * (1 + (team.count(id(p)) if double else 0))
    assert abs(model.norm.mean - y.mean()) < 1e-9 and abs(model.norm.std - y.std()) < 1e-9


def test_diverged_members_are_dead_until_the_next_pool():
    model = automl.AdaptiveRegressor(2, window=4, budget=4)
    model.pool[3].model.predict = lambda _: float("nan")
    model.pool[4].model.predict = lambda _: -2e6
    x, y = flipping(4, classes=False, width=2)
    for i in range(3):
        model.learn(x[i], y[i])
    assert {3, 4} <= model.dead
    model.learn(x[3], y[3])
    assert model.dead == set() and len(model.pool) == 4


def test_evolving_population_equals_a_plain_loop():
    x, y = flipping(150)
    model = automl.EvolvingClassifier(3, window=50, population=4, rate=2.0, seed=9)
    dice = Dice("EvolvingClassifier", 9)
    team = [Pipeline(preset("classification", dice), 3) for _ in range(4)]
    hits = [[] for _ in team]
    for i, (row, label) in enumerate(zip(x, y)):
        total = {}
        for p in team:
            for c, v in p.proba(row).items():
                total[c] = total.get(c, 0) + v
        want = min(total, key=lambda c: (-total[c], c)) if total else None
        assert model.predict(row) == want
        model.learn(row, label)
        if i and i % 50 == 0:
            fit = [sum(h) / len(h) for h in hits]
            best, worst = fit.index(max(fit)), fit.index(min(fit))
            other, part = preset("classification", dice), dice.pick(("scaler", "learner"))
            parent = team[best].config
            config = Config(parent.algo, parent.params, other.scaler) if part == "scaler" else Config(other.algo, other.params, parent.scaler)
            chain = Chain(config, 3) if part == "scaler" else copy.deepcopy(team[best].chain)
            team[worst], hits[worst] = Pipeline(config, 3, chain), []
        for p, h in zip(team, hits):
            h.append(p.predict(row) == label)
            for _ in range(dice.poisson(2.0)):
                p.learn(row, label)
    assert [e for _, e, *_ in model.log] == ["mutated"] * 2


def test_genetic_search_replaces_the_worst():
    model = automl.GeneticClassifier(3, window=40, population=5, rate=1.0, seed=2)
    assert all(p.config.scaler is None for p in model.team)
    run_rows(model, *flipping(400))
    events = [e for _, e, *_ in model.log]
    assert len(events) == 10 and set(events) <= {"taken", "refused"} and "taken" in events and len(model.team) == 5


def test_online_automl_equals_its_parts():
    x, y = flipping(900, seed=6)
    model = automl.OnlineAutoml(3, warm_up=60, budget=4, recent=80, seed=1)
    got = run_rows(model, x, y)
    assert got[:60] == [None] * 60
    dice, detector = Dice("OnlineAutoml", 1), Eddm()

    def best(a, b):
        own = []
        for config in [preset("classification", dice) for _ in range(4)]:
            p = Pipeline(config, 3)
            split = int(0.8 * (b - a))
            for i in range(a, a + split):
                p.learn(x[i], y[i])
            own.append((sum(p.predict(x[i]) == y[i] for i in range(a + split, b)), p))  # nothing is learned here
        return max(own, key=lambda o: o[0])[1]

    now, want, drifts = best(0, 60), [], 0
    for i in range(60, 900):
        want.append(now.predict(x[i]))
        now.learn(x[i], y[i])
        if detector.update(float(want[-1] != y[i])):
            now, detector, drifts = best(max(0, i + 1 - 80), i + 1), Eddm(), drifts + 1
    assert got[60:] == want and drifts == sum(e == "drift" for _, e, *_ in model.log)


def test_holdout_learns_nothing_from_the_rest(spark):
    x, y = flipping(100)
    rows = [("s", i + 1, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))] + [("t", i + 1, x[i].tolist(), 0) for i in range(3)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, x array<double>, y int").repartition(4)
    got = {r.member: (r.config, r.score, r.best) for r in search.holdout_search(df, budget=6, seed=3).collect()}
    want = []
    for config in search.holdout_configs(6, 3):
        p = Pipeline(config, 3)
        for i in range(80):
            p.learn(x[i], y[i])
        want.append((config.name, sum(p.predict(x[i]) == y[i] for i in range(80, 100)) / 20))
    top = max(range(6), key=lambda i: (want[i][1], -i))
    assert got == {i: (*w, i == top) for i, w in enumerate(want)}


def test_champion_finds_the_product():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 3))
    y = 0.5 * x[:, 0] + 2 * x[:, 1] * x[:, 2]
    model = automl.ChampionRegressor(3, seed=1)
    pred = np.array(run_rows(model, x, y))
    assert (1, 2) in model.champion.pairs and len(model.live) <= 4
    assert any(e == "promoted" for _, e, *_ in model.log)
    assert np.abs(pred - y)[-500:].mean() < 0.5 * np.abs(y).mean()


# --- forests and trees -----------------------------------------------------------------------------------

def test_cut_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for n in (2, 3, 30):
        x, y = np.round(rng.uniform(0, 1, n), 1), rng.normal(size=n)
        cuts = [(y.std() - ((x <= t).sum() * y[x <= t].std() + (x > t).sum() * y[x > t].std()) / n, t) for t in np.unique(x)[:-1]]
        gain, at = forest.best_cut(x, y)
        assert not cuts or abs(gain - max(c[0] for c in cuts)) < 1e-9
        assert not cuts or any(abs(c[0] - gain) < 1e-9 and (x <= at).tolist() == (x <= c[1]).tolist() for c in cuts)


@pytest.mark.parametrize(("combine", "leaf"), [("mean", "mean"), ("median", "model"), ("median", "adaptive")])
def test_forest_follows_a_step_and_its_turn(combine, leaf):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (3000, 3))
    y = np.where(x[:, 1] > 0.5, 3.0, -1.0) * np.where(np.arange(3000) < 1500, 1, -1) + rng.normal(0, 0.1, 3000)
    model = forest.ForestRegressor(3, models=5, combine=combine, leaf=leaf, seed=2)
    error = np.abs(np.array(run_rows(model, x, y)) - y)
    assert sum(t.splits for t in model.trees) > 0 and model.replaced > 0
    assert error[1000:1500].mean() < 0.5 and error[1500:1510].mean() > 1.0 and error[2500:].mean() < 0.5
    with pytest.raises(ValueError):
        forest.ForestRegressor(3, combine="most")


class PlainTree:
    """A Hoeffding tree from its definition, one number at a time."""

    def __init__(self, width, grace, delta, tie):
        self.width, self.grace, self.delta, self.tie, self.seen = width, grace, delta, tie, set()
        self.nodes = [{"rows": {}, "weight": 0.0, "depth": 0}]

    def leaf(self, x):
        node = self.nodes[0]
        while "feature" in node:
            node = self.nodes[node["left"] if x[node["feature"]] <= node["at"] else node["right"]]
        return node

    def predict(self, x):
        rows = self.leaf(x)["rows"]
        return min(rows, key=lambda c: (-rows[c]["n"], c)) if rows else 0

    def learn(self, x, y):
        self.seen.add(y)
        node = self.leaf(x)
        own = node["rows"].setdefault(y, {"n": 0.0, "stats": [[0.0, 0.0, 0.0] for _ in range(self.width)]})
        own["n"] += 1
        node["weight"] += 1
        for s, v in zip(own["stats"], x):
            s[0] += 1
            d = v - s[1]
            s[1] += d / s[0]
            s[2] += d * (v - s[1])
        if int(node["weight"]) % self.grace == 0 and len(self.seen) > 1:
            self.split(node)

    def split(self, node):
        entropy = lambda c: -sum(v / sum(c) * math.log2(v / sum(c)) for v in c if v > 0)
        classes, found = sorted(node["rows"]), []
        n = [node["rows"][c]["n"] for c in classes]
        for f in range(self.width):
            stats = [node["rows"][c]["stats"][f] for c in classes]
            at = sum(a * s[1] for a, s in zip(n, stats)) / sum(n)
            share = []
            for s in stats:
                sd = math.sqrt(s[2] / (s[0] - 1)) if s[0] > 1 else 0.0
                share.append(0.5 * (1 + math.erf((at - s[1]) / (sd * math.sqrt(2)))) if sd > 0 else float(at >= s[1]))
            left, right = [a * p for a, p in zip(n, share)], [a * (1 - p) for a, p in zip(n, share)]
            found.append((entropy(n) - sum(left) / sum(n) * entropy(left) - sum(right) / sum(n) * entropy(right), f, at, share))
        order = sorted(found, key=lambda v: (-v[0], v[1]))
        epsilon = math.sqrt(math.log2(len(self.seen)) ** 2 * math.log(1 / self.delta) / (2 * sum(n)))
        lead = order[0][0] - order[1][0]
        if order[0][0] <= 0 or not (lead > epsilon or (lead < self.tie and epsilon < self.tie)):
            return
        _, f, at, share = order[0]
        for side in ("left", "right"):
            part = share if side == "left" else [1 - p for p in share]
            rows = {c: {"n": a * p, "stats": [[s[0] * p, s[1], s[2] * p] for s in node["rows"][c]["stats"]]} for c, a, p in zip(classes, n, part) if a * p > 0}
            node[side] = len(self.nodes)
            self.nodes.append({"rows": rows, "weight": sum(r["n"] for r in rows.values()), "depth": node["depth"] + 1})
        node["feature"], node["at"] = f, at


@pytest.mark.parametrize("delta", [1e-7, 0.05])
def test_tree_equals_a_plain_tree(delta):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 3))
    y = (x[:, 1] > 0.2).astype(int) + (x[:, 0] > 0.5)
    tree, plain = trees.HoeffdingTree(3, delta=delta), PlainTree(3, 200, delta, 0.05)
    assert run_rows(tree, x, y) == run_rows(plain, x.tolist(), y.tolist())
    assert len(plain.nodes) >= 3


class Deferred(trees.HoeffdingTree):
    """A tree that splits at the end of a block only."""

    def begin(self):
        self.before, self.grace, self.often = {}, 10**12, self.often if hasattr(self, "often") else self.grace

    def leaves(self, node=None, depth=0):
        node = node or self.root
        return [(node, depth)] if node.feature is None else self.leaves(node.left, depth + 1) + self.leaves(node.right, depth + 1)

    def end(self):
        for node, depth in self.leaves():
            if int(node.weight // self.often) > int(self.before.get(id(node), 0.0) // self.often) and depth < self.depth and len(self.seen) > 1:
                self._split(node)
        self.before = {id(n): n.weight for n, _ in self.leaves()}


def grow_rows(spark, n, seed=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 1] > 0.2).astype(int) + (x[:, 0] > 0.5)
    df = spark.createDataFrame([("s", i + 1, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "stream_id string, seq long, x array<double>, y int")
    return x, y, df.repartition(4).cache()


@pytest.mark.parametrize("case_nodes", [64, 1])
def test_grown_tree_equals_blocks_of_the_fold(spark, monkeypatch, case_nodes):
    monkeypatch.setattr(tree_growth, "CASE_NODES", case_nodes)
    x, y, df = grow_rows(spark, 2600)
    preds, tree, leaves = tree_growth.grown(df, (0, 1, 2), 3, block=650, grace=200, delta=0.05)
    plain, want = Deferred(3, grace=200, delta=0.05), []
    for at in range(0, len(x), 650):
        plain.begin()
        want += run_rows(plain, x[at : at + 650], y[at : at + 650])
        plain.end()
    assert [r.pred for r in preds.orderBy("seq").collect()] == want
    assert sum(f >= 0 for f in tree.feature) >= 2
    assert abs(sum(r.n for r in leaves.collect()) - 2600) < 1e-6


def test_grown_tree_is_the_fold_while_leaves_fill_whole_blocks(spark):
    x, y, df = grow_rows(spark, 900)
    preds, tree, _ = tree_growth.grown(df, (0, 1, 2), 3, block=300, grace=300, delta=1e-7)
    want = [r.pred for r in prequential(df, "hoeffding_tree", {"grace": 300}).orderBy("seq").collect()]
    assert [r.pred for r in preds.orderBy("seq").collect()][:600] == want[:600]
    assert tree_growth.grown(df.limit(0), (0, 1), 3)[0].collect() == []
    assert KERNELS["hoeffding_tree"][1] == "classification"


@pytest.mark.parametrize("span", [1, 700, 10**6])
def test_grown_tree_does_not_depend_on_spans_of_blocks(spark, monkeypatch, span):
    monkeypatch.setattr(tree_growth, "SPAN_ROWS", span)
    x, y, df = grow_rows(spark, 2600)
    plain, want = Deferred(3, grace=100, delta=0.05), []
    for at in range(0, len(x), 300):
        plain.begin()
        want += run_rows(plain, x[at : at + 300], y[at : at + 300])
        plain.end()
    spark.sparkContext.setJobGroup(f"grow {span}", "")
    preds, tree, leaves = tree_growth.grown(df, (0, 1, 2), 3, block=300, grace=100, delta=0.05)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grow {span}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.pred for r in preds.orderBy("seq").collect()] == want
    assert sum(f >= 0 for f in tree.feature) >= 2 and abs(sum(r.n for r in leaves.collect()) - 2600) < 1e-6
    assert jobs < 12 or span < 10**6
