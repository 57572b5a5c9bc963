"""Scans, learners, metrics and drift against row-by-row loops, and the pinned semantics."""

import copy
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamtrial.operators import drift, ensemble, kernels, metrics, neighbours, pool, scaling, trees
from streamtrial.operators.fold import KERNELS, prequential, register, run_rows, sweep
from streamtrial.operators.naive_bayes import naive_bayes
from streamtrial.operators.numbering import numbered
from streamtrial.operators.scan import scan
from streamtrial.plans import suite
from streamtrial.sources import results, tables
from streamtrial.streaming.live import live_predictions, run_available

SCHEMA = "stream_id string, seq long, x array<double>, y int"


def rows(n, width=3, classes=3, seed=0, stream="s"):
    rng = random.Random(seed)
    return [(stream, i + 1, [round(rng.gauss(c, 1), 3) for _ in range(width)], c) for i in range(n) for c in [rng.randrange(classes)]]


@pytest.fixture(scope="module")
def stream(spark):
    return spark.createDataFrame(rows(300) + rows(70, seed=1, stream="t"), SCHEMA).cache()


def test_numbering(spark):
    values = [(random.Random(i).randrange(50), i) for i in range(500)]
    got = {r.i: r.seq for r in numbered(spark.createDataFrame(values, "k long, i long").repartition(7), ["k", "i"]).collect()}
    assert [i for _, i in sorted(values)] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "k long, i long"), ["k", "i"]).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scan_does_not_depend_on_blocks(stream, block):
    v = F.col("x")[0]
    for inclusive in (False, True):
        got = {(r.stream_id, r.seq): (r.s, r.lo, r.hi) for r in scan(stream, {"s": ("sum", v), "lo": ("min", v), "hi": ("max", v)}, inclusive, block).collect()}
        for name, n, seed in (("s", 300, 0), ("t", 70, 1)):
            x = [r[2][0] for r in rows(n, seed=seed)]
            for i in range(n):
                part = x[: i + inclusive]
                s, lo, hi = got[(name, i + 1)]
                assert math.isclose(s, sum(part), abs_tol=1e-9) and (lo, hi) == ((min(part), max(part)) if part else (None, None))


def test_online_minmax_pin(spark):
    df = spark.createDataFrame([("a", i + 1, [v], 0) for i, v in enumerate((0.0, 10.0, 20.0))], SCHEMA)
    assert [r.g0 for r in scaling.scaled(df, 1, "online").orderBy("seq").collect()] == [0.0, 1.0, 1.0]


def test_naive_bayes_equals_a_loop(stream):
    got = {(r.stream_id, r.seq): r.pred for r in naive_bayes(stream, (0, 1, 2), 3).collect()}
    for name, n, seed in (("s", 300, 0), ("t", 70, 1)):
        seen = {}
        for _, seq, x, y in rows(n, seed=seed):
            best, pred = -math.inf, -1
            total = sum(len(v) for v in seen.values())
            for c in sorted(seen):
                z = math.log(len(seen[c]) / total)
                for f in range(3):
                    v = [r[f] for r in seen[c]]
                    var = np.var(v, ddof=1) if len(v) > 1 else 0
                    d = 0.0 if len(v) < 2 else math.exp(-0.5 * (x[f] - np.mean(v)) ** 2 / var) / math.sqrt(2 * math.pi * var)
                    z += math.log(max(d, 1e-300))
                if z > best:
                    best, pred = z, c
            assert got[(name, seq)] == pred
            seen.setdefault(y, []).append(x)


@pytest.mark.parametrize("p", [1, 2, 3])
def test_nearest_neighbours_equal_a_loop(stream, p):
    got = {(r.stream_id, r.seq): r.pred for r in neighbours.knn_classify(stream, 5, 40, p).collect()}
    data = rows(300)
    for i in (0, 1, 4, 39, 40, 41, 150, 299):
        near = sorted((sum(abs(a - b) ** p for a, b in zip(data[i][2], data[j][2])), data[j][3], j) for j in range(max(0, i - 40), i))[:5]
        votes = [c for _, c, _ in near]
        assert got[("s", i + 1)] == (max(sorted(set(votes)), key=votes.count) if votes else -1)


def test_windows_keep_the_tail(spark):
    preds = spark.createDataFrame([("s", i + 1, 1, 1) for i in range(300)], "stream_id string, seq long, y int, pred int")
    per = metrics.classification(preds, metrics.window_no(128))
    assert sorted((r.window_no, r.n_samples, r.accuracy) for r in per.collect()) == [(0, 128, 1.0), (1, 128, 1.0), (2, 44, 1.0)]
    assert metrics.complete_windows(preds, 128).first().windows == 2


def test_failed_runs_do_not_count(spark):
    runs = spark.createDataFrame([("m", "d", "classification", 1, None, 10, 0.8, None), ("m", "d", "classification", 2, None, 0, 0.0, "stopped")], "framework string, dataset string, task string, run_id long, seed long, n_samples long, accuracy double, error string")
    r = metrics.summary(runs, ["accuracy"]).first()
    assert (r.n_runs, r.n_ok, r.n_failed, r.accuracy_mean, r.accuracy_std) == (2, 1, 1, 0.8, 0.0)
    text = {t.run_id: t.accuracy for t in results.csv_rows(runs, ["accuracy"]).collect()}
    assert text == {1: "0.800000", 2: ""}
    with pytest.raises(ValueError):
        results.merged(runs, runs.withColumn("task", F.lit("regression")))
    with pytest.raises(TypeError):
        results.merged(runs, runs.drop("seed"))
    with pytest.raises(RuntimeError):
        results.to_csv(runs.limit(0), ["accuracy"], "/tmp/none")


def test_probabilities_sum_to_one(stream):
    for algo in ("perceptron", "logistic", "softmax", "passive_aggressive", "hoeffding_tree", "gradient_tree"):
        sums = [sum(r.proba.values()) for r in prequential(stream, algo, proba=True).where("seq > 5").collect()]
        assert all(abs(s - 1) < 1e-9 for s in sums)


def test_learners_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] > 0.2).astype(int)
    floors = {"perceptron": 0.8, "logistic": 0.8, "softmax": 0.8, "passive_aggressive": 0.8, "hoeffding_tree": 0.8, "efdt": 0.8}
    for algo, floor in floors.items():
        model = KERNELS[algo][0](3, **({"lr": 0.1} if algo in ("logistic", "softmax") else {}))
        good = 0
        for a, b in zip(x, y):
            good += model.predict(a) == b
            model.learn(a, int(b))
        assert good / len(x) > floor, algo
    target = 2 * x[:, 0] - x[:, 1] + 0.5
    for algo in ("linear", "bayesian_linear", "passive_aggressive_reg", "hoeffding_tree_reg"):
        model = KERNELS[algo][0](3)
        errors = []
        for a, b in zip(x, target):
            errors.append((model.predict(a) - b) ** 2)
            model.learn(a, float(b))
        assert 1 - sum(errors) / ((target - target.mean()) ** 2).sum() > 0.5, algo


def test_fresh_learners_say_what_is_fixed():
    x = np.zeros(3)
    assert kernels.Logistic(3).predict(x) == 0 and trees.HoeffdingTree(3).predict(x) == 0 and trees.GradientLeaf(3).predict(x) == 1
    assert kernels.LinearSgd(3).predict(x) == 0.0


def test_tree_splits_where_classes_part():
    tree = trees.HoeffdingTree(2, grace=100)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        y = int(rng.integers(2))
        tree.learn(np.array([rng.normal(), y * 6 + rng.normal()]), y)
    assert tree.root.feature == 1 and 1.5 < tree.root.threshold < 4.5
    assert tree.predict(np.array([0.0, 6.0])) == 1 and tree.predict(np.array([0.0, 0.0])) == 0


def test_pluggable_learner_and_failures(stream):
    class Constant:
        def __init__(self, width, value=1):
            self.value = value

        def predict(self, x):
            return self.value

        def learn(self, x, y):
            pass

    register("constant", Constant, "classification")
    assert {r.pred for r in prequential(stream, "constant", {"value": 2}).collect()} == {2}
    got = sweep(stream, [("ok", "constant", {}), ("bad", "constant", {"nothing": 1})])
    assert got.where("config_id = 'bad' and error is not null").count() == 2 and got.where("config_id = 'ok'").count() == 370
    del KERNELS["constant"]


def test_drift_detectors():
    rng = random.Random(3)
    for make in (drift.Adwin, drift.Eddm):
        quiet, loud = make(), make()
        calm = [quiet.update(float(rng.random() < 0.2)) for _ in range(3000)]
        moved = [loud.update(float(rng.random() < (0.1 if i < 1500 else 0.6))) for i in range(3000)]
        assert any(moved[1500:]) and sum(calm) <= 2
    window = drift.Adwin()
    for _ in range(1000):
        window.update(1.0)
    assert window.width == 1000 and window.mean == 1.0


def test_poisson_draws(spark):
    n = spark.range(20_000).select(ensemble.poisson(6.0, F.lit(1), F.col("id")).alias("k"))
    r = n.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert abs(r.m - 6) < 0.1 and abs(r.v - 6) < 0.3


def test_csv_loader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,a,b,label\n1,1.5,x,no\n2,,y,yes\n3,2.5,7,yes\n4,1,1,maybe\n")
    got = tables.csv_classification(spark, str(tmp_path / "a.csv"), "label", "k", "k long, a double, b string, label string", most=4).orderBy("k").collect()
    assert [(r.k, list(r.x), r.y) for r in got] == [(1, [1.5, 0.0], 1), (3, [2.5, 7.0], 2), (4, [1.0, 1.0], 0)]


def test_grids():
    assert pool.spread(50, 500, 50) == list(range(50, 501, 50)) and pool.spread(200, 2000, 200)[-1] == 2000
    assert len(pool.spread(0.001, 0.1, 0.005)) == 20 and pool.spread(0.0, 0.01, 0.001)[-1] == 0.01
    assert pool.spread(1, 0, 1) == []


def test_pool_kernels_equal_the_joins(stream):
    same = lambda a, b: {(r.stream_id, r.seq): r.pred for r in a.collect()} == {(r.stream_id, r.seq): r.pred for r in b.collect()}
    assert same(prequential(stream, "naive_bayes"), naive_bayes(stream, (0, 1, 2), 3))
    assert same(prequential(stream, "knn", {"window": 40}), neighbours.knn_classify(stream, 5, 40))
    for algo in ("naive_bayes", "knn"):
        p = [r.proba for r in prequential(stream, algo, proba=True).collect()]
        assert all(not m or abs(sum(m.values()) - 1) < 1e-9 for m in p) and sum(not m for m in p) == 2


def test_suite_arguments():
    m = {"a": ("perceptron", {})}
    assert suite.list_datasets("regression") == ["ev_amount", "ev_value", "li_lots_revenue", "li_revenue"]
    assert suite.Suite(m, "classification", n_runs=3).run_seeds == [0, 1, 2] and suite.Suite(m, "classification").run_seeds == [None]
    for bad in ({"models": {}}, {"task": "ranking"}, {"n_runs": 0}, {"window": 0}, {"most": 0}, {"n_runs": 2, "seeds": [1]}, {"datasets": []}, {"datasets": ["ev_value"]}):
        with pytest.raises(ValueError):
            suite.Suite(**({"models": m, "task": "classification"} | bad))


def test_suite_keeps_what_came_before_a_fault(spark):
    class Fails:
        def __init__(self, width, **_):
            self.n = 0

        def predict(self, x):
            return None if self.n < 3 else 1

        def learn(self, x, y):
            self.n += 1
            if self.n > 5:
                raise RuntimeError("full")

    register("fails", Fails, "classification")
    s = suite.Suite({"bad": ("fails", {}), "bag": ("bagged_naive_bayes", {"members": 2})}, "classification", ["ev_users"], n_runs=2, seeds=[4, 9], most=10, window=4)
    preds = s.predictions(spark, "/root/testdata/sf0.001").cache()
    runs = {(r.framework, r.run_id): r for r in s.runs(preds).collect()}
    users = preds.select("stream_id").distinct().count()
    bad, bag = runs["bad", 0], runs["bag", 1]
    assert bad.status == "failed" and "full" in bad.error and bad.n_samples == 5 * users and bad.task_index == 1
    assert bag.status == "finished" and bag.seed == 9 and bag.rows_per_s > 0 and (bag.task_index, bag.task_total) == (4, 4) and bag.finished_at >= bag.started_at
    assert preds.where("framework = 'bad' and run_id = 0 and seq <= 3 and pred is not null").count() == 0
    rows = [r for r in preds.where("framework = 'bag' and run_id = 1").orderBy("stream_id", "seq").collect()]
    from streamtrial.plans.streams import instances

    mine = [r for r in instances(spark, "/root/testdata/sf0.001", "ev_users").where("seq <= 10 and stream_id = '" + rows[0].stream_id + "'").orderBy("seq").collect()]
    model, want = pool.Bagged(3, members=2, seed=9), []
    for r in mine:
        want.append(float(model.predict(np.array(r.x))))
        model.learn(np.array(r.x), r.y)
    assert [r.pred for r in rows if r.stream_id == rows[0].stream_id] == want
    total = {r.framework: r for r in suite.aggregated(s.runs(preds), "classification").collect()}
    assert total["bad"].n_failed == 2 and len(total["bad"].errors) == 2 and total["bad"].accuracy_mean is None and total["bag"].seeds == [4, 9]
    text = {(r.framework, r.run_id): r for r in results.csv_rows(s.runs(preds), ["accuracy"]).collect()}
    assert text["bad", 0].accuracy == "" and len(text["bag", 0].total_time_s.split(".")[1]) == 4
    assert [r.rank for r in suite.ranking(s.runs(preds), "classification").collect()] == [1]
    with pytest.raises(ValueError):
        suite.aggregated(s.runs(preds).limit(0), "classification")


def test_live_equals_batch(spark, stream, tmp_path):
    stream.repartition(3, "stream_id").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(stream.schema).parquet(str(tmp_path / "in"))
    run_available(live_predictions(live, "logistic"), str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda df: sorted((r.stream_id, r.seq, r.pred) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(prequential(stream, "logistic"))


# --- parameter mixing ------------------------------------------------------------------------------------

def _line_stream(spark, n, classes=0, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.1 * rng.normal(size=n)) if not classes else np.minimum((x[:, 0] * classes).astype(int), classes - 1)
    kind = "int" if classes else "double"
    return x, y, spark.createDataFrame([("s", i + 1, r.tolist(), v.item()) for i, (r, v) in enumerate(zip(x, y))], f"stream_id string, seq long, x array<double>, y {kind}")


@pytest.mark.parametrize("algo", ["perceptron", "logistic", "softmax", "passive_aggressive", "linear", "bayesian_linear", "passive_aggressive_reg"])
def test_mixing_with_one_shard_is_the_fold(spark, algo):
    from streamtrial.operators.parameter_mixing import mixed

    classes = 3 if KERNELS[algo][1] == "classification" else 0
    x, y, df = _line_stream(spark, 230, classes)
    got = [r.pred for r in mixed(df, algo, shards=1, shard_rows=90).orderBy("seq").collect()]
    assert np.allclose(got, run_rows(KERNELS[algo][0](3), x, y), atol=1e-9)


@pytest.mark.parametrize("algo", ["logistic", "bayesian_linear"])
def test_mixing_equals_plain_rounds(spark, algo):
    from streamtrial.operators.parameter_mixing import mixed

    shards, size = 3, 20
    x, y, df = _line_stream(spark, 170, 2 if algo == "logistic" else 0)
    want, start = [], KERNELS[algo][0](3)
    for at in range(0, len(x), shards * size):
        parts = []
        for s in range(at, min(at + shards * size, len(x)), size):
            model = copy.deepcopy(start)
            want += run_rows(model, x[s : s + size], y[s : s + size])
            parts.append((model, len(x[s : s + size])))
        if algo == "logistic":
            start.classes = sorted(set().union(*[m.classes for m, _ in parts]))
            own = [[(m.w[m.classes.index(c)], n) for m, n in parts if c in m.classes] for c in start.classes]
            start.w = np.array([sum(w * n for w, n in o) / sum(n for _, n in o) for o in own])
        else:
            p = [np.append(m.precision, m.precision_b) for m, _ in parts]
            w = sum(q * np.append(m.w, m.b) for q, (m, _) in zip(p, parts)) / sum(p)
            total = sum(p) - (len(p) - 1) * np.append(start.precision, start.precision_b)
            start.w, start.b, start.precision, start.precision_b = w[:-1], w[-1], total[:-1], total[-1]
    got = [r.pred for r in mixed(df, algo, shards=shards, shard_rows=size).orderBy("seq").collect()]
    assert np.allclose(got, want, atol=1e-9)
    assert mixed(df.limit(0), algo).collect() == []


def test_places_by_halving(spark):
    from streamtrial.operators.numbering import place

    for count in (1, 5, 64, 65, 300):
        bounds = [3 * i for i in range(count)]
        df = spark.createDataFrame([(v,) for v in (-1, 0, 1, 3, 100, 191, 192, 193, 10_000)], "v long")
        assert all(r.p == sum(b <= r.v for b in bounds) for r in df.select("v", place(F.col("v"), bounds).alias("p")).collect())


def test_every_epoch_of_one_stream(spark):
    """Block scans with a short look ahead find the drifts that the detector finds row by row."""
    rng = random.Random(2)
    values = [int(rng.random() < p) for p in (0.05, 0.3, 0.1, 0.6) for _ in range(700)]
    detector = drift.Eddm()
    want = [i + 1 for i, v in enumerate(values) if detector.update(float(v))]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "stream_id string, seq long, value int").repartition(3).cache()
    assert len(want) >= 3
    assert [r.seq for r in drift.every_eddm(df, look=300).orderBy("seq").collect()] == want
    assert drift.every_eddm(df.limit(0)).collect() == []


def test_moments_merge(spark):
    from streamtrial.operators import moments

    rng = np.random.default_rng(1)
    v, w, g = rng.normal(1e6, 1, 300), rng.integers(0, 4, 300), rng.integers(0, 5, 300)
    rows = [(float(a), int(b), int(c)) for a, b, c in zip(v, w, g)] + [(None, 3, 0), (5.0, 0, 7), (None, 1, 8)]
    df = spark.createDataFrame(rows, "v double, w int, g int")
    states = df.groupBy("g").agg(moments.state(F.col("v"), F.col("w"), 1e6).alias("s")).cache()
    one = states.agg(moments.total(F.col("s"), 1e6).alias("s")).select("s.*", moments.variance(F.col("s")).alias("var")).first()
    full = np.repeat(v, w)
    assert one.n == len(full) and abs(one.mean - full.mean()) < 1e-6 and abs(one["var"] - full.var(ddof=1)) < 1e-6
    pair = states.where("g = 1").select(F.col("s").alias("a")).crossJoin(states.where("g = 2").select(F.col("s").alias("b"))).crossJoin(states.where("g = 8").select(F.col("s").alias("c")))
    got = pair.select(moments.merged(moments.merged(F.col("a"), F.col("b")), F.col("c")).alias("s")).select("s.*").first()
    full = np.repeat(v[(g == 1) | (g == 2)], w[(g == 1) | (g == 2)])
    assert got.n == len(full) and abs(got.mean - full.mean()) < 1e-6 and abs(got.m2 / (got.n - 1) - full.var(ddof=1)) < 1e-6


@pytest.mark.parametrize("algo", ["softmax", "bayesian_linear"])
def test_typed_state_equals_batch_over_restarts(spark, tmp_path, algo):
    """Micro-batches, a restart in the middle, and late rows that are dropped and counted."""
    from streamtrial.streaming.typed import typed_predictions

    kind = "int" if KERNELS[algo][1] == "classification" else "double"
    whole = spark.createDataFrame(rows(60) + rows(50, seed=1, stream="t"), SCHEMA).withColumn("y", F.col("y").cast(kind)).cache()
    put = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: run_available(typed_predictions(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), algo), str(tmp_path / "out"), str(tmp_path / "state"))
    put(whole.where("seq <= 20"))
    put(whole.where("seq > 20 and seq <= 35"))
    go()
    put(whole.where("seq = 30"))
    put(whole.where("seq > 35"))
    go()
    out = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: [(r.stream_id, r.seq, round(float(r.pred), 9)) for r in df.orderBy("stream_id", "seq").collect()]
    assert key(out) == key(prequential(whole, algo))
    assert out.where("seq > 35").agg(F.min("late"), F.max("late")).first() == (1, 1)
    state = spark.read.format("statestore").option("stateVarName", "cursor").load(str(tmp_path / "state")).select("key.stream_id", "value.*").collect()
    assert sorted((r.stream_id, r.last, r.rows, r.late) for r in state) == [("s", 60, 60, 1), ("t", 50, 50, 1)]
    with pytest.raises(ValueError):
        typed_predictions(whole, "knn")


# --- many rounds, many streams ---------------------------------------------------------------------------

LINEAR = ["perceptron", "logistic", "softmax", "passive_aggressive", "linear", "bayesian_linear", "passive_aggressive_reg"]


@pytest.mark.parametrize("algo", LINEAR)
def test_lockstep_equals_the_kernels(algo):
    from streamtrial.operators.lockstep import LOCKSTEP, run_streams

    rng = np.random.default_rng(5)
    lengths = np.array([40, 40, 17, 3, 1])
    x = rng.normal(size=(lengths.sum(), 3))
    y = np.round(rng.uniform(0, 4, len(x))).astype(int) if KERNELS[algo][1] == "classification" else x @ [1.0, -2.0, 0.5]
    x[50, 1] = np.nan
    model, at = LOCKSTEP[KERNELS[algo][0]](len(lengths), 3, y), 0
    got = run_streams(model, x, y, lengths)
    for n, state in zip(lengths, model.state(lengths)):
        plain = KERNELS[algo][0](3)
        assert np.allclose(got[at : at + n].astype(float), run_rows(plain, x[at : at + n], y[at : at + n]), atol=1e-9, equal_nan=True)
        want = plain.state(int(n))
        assert [s[:2] for s in state] == [s[:2] for s in want] and np.allclose([s[2:] for s in state], [s[2:] for s in want], atol=1e-9, equal_nan=True)
        at += n


@pytest.mark.parametrize("span", [1, 120, 10**6])
@pytest.mark.parametrize("algo", ["softmax", "bayesian_linear"])
def test_jobs_of_mixing_do_not_grow_with_its_rounds(spark, monkeypatch, algo, span):
    from streamtrial.operators import parameter_mixing

    monkeypatch.setattr(parameter_mixing, "SPAN_ROWS", span)
    x, y, df = _line_stream(spark, 310, 2 if algo == "softmax" else 0)
    want, start = [], None
    for at in range(0, 310, 60):
        states = []
        for s in range(at, min(at + 60, 310), 20):
            model = KERNELS[algo][0](3)
            if start:
                model.restore(start)
            want += run_rows(model, x[s : min(s + 20, at + 60)], y[s : min(s + 20, at + 60)])
            states.append(model.state(len(x[s : s + 20]), start))
        start = parameter_mixing.mean_state(states, start)
    spark.sparkContext.setJobGroup(f"mix {algo} {span}", "")
    out = parameter_mixing.mixed(df, algo, shards=3, shard_rows=20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"mix {algo} {span}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose([r.pred for r in out.orderBy("seq").collect()], want, atol=1e-9)
    assert jobs < 12 or span < 10**6


@pytest.mark.parametrize("chunk", [1, 40, 10**6])
@pytest.mark.parametrize("algo", LINEAR)
def test_streams_folded_together_equal_single_ones(spark, monkeypatch, algo, chunk):
    from streamtrial.operators import fold

    monkeypatch.setattr(fold, "CHUNK_ROWS", chunk)
    kind, sizes = KERNELS[algo][1], {"a": 70, "b": 1, "c": 33}
    table = [(s, i, x, y if kind == "classification" else x[0] - y) for s, n in sizes.items() for _, i, x, y in rows(n, seed=n)]
    df = spark.createDataFrame(table[::-1], SCHEMA if kind == "classification" else SCHEMA.replace("y int", "y double"))
    want, shares = [], []
    for s in sizes:
        model = KERNELS[algo][0](3)
        for t in table:
            if t[0] == s:
                want.append(model.predict(np.array(t[2])))
                shares.append(model.proba(np.array(t[2])) if kind == "classification" else None)
                model.learn(np.array(t[2]), t[3])
    got = prequential(df, algo, proba=kind == "classification")
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    got = got.orderBy("stream_id", "seq").collect()
    assert np.allclose([r.pred for r in got], want, atol=1e-9)
    if kind == "classification":
        assert [sorted(r.proba) for r in got] == [sorted(p) for p in shares] and all(abs(r.proba[c] - v) < 1e-9 for r, p in zip(got, shares) for c, v in p.items())
    bags = {(r.member, r.stream_id, r.seq): r.pred for r in ensemble.bagging(df, algo, 2).collect()}
    draws = df.withColumn("times", ensemble.poisson(6.0, F.lit(0), F.lit(1), F.col("stream_id"), F.col("seq"))).orderBy("seq").where("stream_id = 'a'").collect()
    want = run_rows(KERNELS[algo][0](3), np.array([r.x for r in draws]), [r.y for r in draws], [r.times for r in draws])
    assert len(bags) == 208 and np.allclose([bags[1, "a", r.seq] for r in draws], want, atol=1e-9)


def test_catalog_is_numbered_only_where_targets_ask_for_it(spark):
    from streamtrial.plans.queries import QUERIES
    from streamtrial.plans.streams import STREAMS, instances

    sf = "/root/testdata/sf0.001"
    got = QUERIES["a2_dataset_meta"](spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4
    want = [(s.name, s.task, df.count(), s.width, df.select("y").distinct().count() if s.task == "classification" else 0) for s in STREAMS.values() for df in [instances(spark, sf, s.name)]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scaling_where_streams_are_folded_is_that_of_the_scans(spark):
    import pyarrow as pa

    rng, none, nan = np.random.default_rng(8), None, float("nan")
    odd = [[none, nan, 1.0], [none, 1.0, nan], [2.0, none, 3.0], [2.0, 4.0, float("inf")], [1.0, nan, 0.5]]
    x = [*odd, *rng.uniform(-1, 1, (55, 3)).tolist(), *odd[::-1], *np.ones((5, 3)).tolist()]
    y = [*rng.uniform(-1, 1, 50).tolist(), none, 2.0, none, *rng.uniform(-1, 1, 7).tolist(), none, *[1.0] * 4, *[3.0] * 5]
    rows = [("a" if i < 60 else "b", i + 1 if i < 60 else i - 59, v, t) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "stream_id string, seq long, x array<double>, y double")
    bounds = np.array([0, 60, 70])
    got = suite.in_range(pa.chunked_array([pa.array(x)]), bounds).to_pylist()
    z, mean, std = (v.to_pylist() for v in suite.around_mean(pa.chunked_array([pa.array(y)]), bounds))
    want = suite.prepared(df, 3, True, True).orderBy("stream_id", "seq").collect()
    assert repr(got) == repr([list(r.x) for r in want])
    assert [v is None for v in z] == [r.z is None for r in want]
    for own, name in ((z, "z"), (mean, "mean"), (std, "std")):
        assert np.allclose([v or 0.0 for v in own], [r[name] or 0.0 for r in want], rtol=1e-9, atol=1e-12)


def test_a_suite_deals_the_rows_of_keyed_streams_once(spark):
    """Before, each run had a copy, and features were scaled in exchanges of their own; runs and windows took several passes over predictions."""
    s = suite.Suite({"a": ("perceptron", {}), "b": ("softmax", {}), "wrong": ("none", {})}, "classification", ["ev_users"], n_runs=2, window=20, normalize=True)
    preds = s.predictions(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan(preds) and plan(preds).count("Exchange hashpartitioning") <= 2 and "Join" not in plan(preds)
    one = s.windows(preds, "accuracy")
    assert plan(one).count("MapInArrow") == 1 and plan(s.windows(preds)).count("MapInArrow") == 1
    want = {(r.framework, r.run_id, r.stream_id, r.window_no): (r.n_samples, r.accuracy) for r in s.windows(preds).collect()}
    assert {(r.framework, r.run_id, r.stream_id, r.window_no): (r.n_samples, r.accuracy) for r in one.collect()} == want
    assert preds.where("framework = 'wrong' and error = \"KeyError: 'none'\" and seq is null").groupBy("run_id").count().count() == 2


def test_streams_without_key_are_dealt_for_each_run(spark):
    s = suite.Suite({"a": ("perceptron", {}), "b": ("naive_bayes", {})}, "classification", ["ev_error", "ev_users"], n_runs=2, most=40)
    rows = {(r.dataset, r.framework, r.run_id): r["count"] for r in s.predictions(spark, "/root/testdata/sf0.001").groupBy("dataset", "framework", "run_id").count().collect()}
    assert len(rows) == 8 and {n for (d, *_), n in rows.items() if d == "ev_error"} == {40} and len(set(rows.values())) == 2
