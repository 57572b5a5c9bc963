"""Prequential evaluation of learners on catalog streams, and suites: learners x datasets x seeds as one Spark job.

A run is a (framework, dataset, run_id). Its rows are folded per stream of the dataset. Streams of a keyed dataset are dealt once, and a
task folds them for one run after the other; other datasets have few streams, so their runs are dealt too. Features and
target are scaled where the stream is folded. Null predictions count as rows.
"""

from __future__ import annotations

import inspect
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamtrial.operators import metrics, scaling
from streamtrial.operators.fold import KERNELS, in_chunks, matrix, run_rows
from streamtrial.operators.lockstep import LOCKSTEP, cut, side_by_side
from streamtrial.plans.storage import stored
from streamtrial.plans.streams import STREAMS, instances

PRIMARY = {"classification": "accuracy", "regression": "r2"}
METRICS = {"classification": ["accuracy", "precision", "recall", "f1"], "regression": ["mae", "rmse", "r2"]}
#: Predictions are clipped to this, so that their squares stay finite.
MOST = 1e150
RUN = ["framework", "dataset", "run_id", "seed"]
PREDICTIONS = pa.schema([("framework", pa.string()), ("dataset", pa.string()), ("run_id", pa.int32()), ("seed", pa.int64()), ("stream_id", pa.string()), ("seq", pa.int64()), ("y", pa.float64()), ("pred", pa.float64()), ("error", pa.string()), ("started", pa.float64()), ("ended", pa.float64())])


def list_datasets(task: str) -> list[str]:
    """The names of the catalog's streams of a task, sorted."""
    if task not in PRIMARY:
        raise ValueError(f"task must be one of {sorted(PRIMARY)}, not {task!r}")
    return sorted(s.name for s in STREAMS.values() if s.task == task)


def prepared(rows: DataFrame, width: int, normalize: bool = False, normalize_target: bool = False, most: int | None = None) -> DataFrame:
    """stream_id, seq, x, y, z, mean, std: the first ``most`` rows of each stream, x scaled by the ranges so far, z the target to learn.

    The target's mean and deviation are those of the rows up to each one; without ``normalize_target`` z is y.
    """
    if most is not None:
        rows = rows.where(F.col("seq") <= most)
    rows = rows.select("stream_id", "seq", "x", F.col("y").cast("double").alias("y"))
    if normalize or normalize_target:
        rows = stored(rows)
    out = rows
    if normalize:
        x = F.array(*[F.col(f"g{i}") for i in range(width)]).alias("x")
        out = out.drop("x").join(scaling.scaled(rows, width, "online").select("stream_id", "seq", x), ["stream_id", "seq"])
    if normalize_target:
        return out.join(scaling.target_normalised(rows).select("stream_id", "seq", "z", "mean", "std"), ["stream_id", "seq"])
    return out.withColumns({"z": F.col("y"), "mean": F.lit(0.0), "std": F.lit(1.0)})


def in_range(x: pa.ChunkedArray, bounds: np.ndarray) -> pa.Array:
    """Features by their ranges up to each row, as ``scaling.scaled`` has them ("online"): null is 0, NaN the greatest number."""
    lists = x.combine_chunks()
    flat = lists.flatten()
    width = len(flat) // max(len(lists), 1)
    none = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width)
    v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    low, high = np.where(none, np.nan, v), np.where(none, -np.inf, v)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        np.fmin.accumulate(low[a:b], out=low[a:b])
        np.maximum.accumulate(high[a:b], out=high[a:b])
    with np.errstate(all="ignore"):
        size = high - low
        out = np.where(~none & ~(size <= 0), (v - low) / size, 0.0)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))


def around_mean(y: pa.ChunkedArray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """z, mean and std of the target up to each row, as ``scaling.target_normalised`` has them."""
    none = y.is_null().to_numpy()
    v = pa.compute.fill_null(y, 0.0).to_numpy().astype(float)
    s, q, n = v.copy(), v * v, np.arange(1, len(v) + 1) - np.repeat(bounds[:-1], np.diff(bounds))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        np.cumsum(s[a:b], out=s[a:b])
        np.cumsum(q[a:b], out=q[a:b])
    with np.errstate(all="ignore"):
        mean = s / n
        std = np.where(n < 2, 1.0, np.sqrt(np.maximum(q / n - mean * mean, 0.0)))
        flat = std <= 0
        z = np.where(flat, 0.0, (v - mean) / std)
    return pa.array(z, mask=none & ~flat), pa.array(mean), pa.array(std)


@dataclass(frozen=True)
class Suite:
    """``models``: name to (kernel, parameters). A kernel that takes a ``seed`` gets the run's, if it has one.

    Without ``seeds`` several runs have the seeds 0, 1, ...; a single run has none. Targets are normalised for
    regression unless ``normalize_target`` says otherwise.
    """

    models: dict[str, tuple[str, dict]]
    task: str
    datasets: list[str] | None = None
    n_runs: int = 1
    seeds: list[int] | None = None
    window: int = metrics.WINDOW
    most: int | None = None
    normalize: bool = False
    normalize_target: bool | None = None

    def __post_init__(self):
        list_datasets(self.task)
        if not self.models:
            raise ValueError("there are no models")
        for name, least in (("n_runs", 1), ("window", 1), ("most", 1)):
            if (v := getattr(self, name)) is not None and v < least:
                raise ValueError(f"{name} must be at least {least}, not {v}")
        if self.seeds is not None and len(self.seeds) != self.n_runs:
            raise ValueError(f"{len(self.seeds)} seeds for {self.n_runs} runs")
        if self.datasets is not None and not self.datasets:
            raise ValueError("there are no datasets")
        for name in self.names:
            if name not in STREAMS or STREAMS[name].task != self.task:
                raise ValueError(f"{name!r} is no dataset for {self.task}")

    @property
    def names(self) -> list[str]:
        return list(self.datasets) if self.datasets is not None else list_datasets(self.task)

    @property
    def run_seeds(self) -> list[int | None]:
        return list(self.seeds) if self.seeds is not None else list(range(self.n_runs)) if self.n_runs > 1 else [None]

    def predictions(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """framework, dataset, run_id, seed, stream_id, seq, y, pred, error, started, ended of all runs.

        A stream on which a learner fails keeps the rows before the fault, and has a row with ``error`` and no seq.
        ``started`` and ``ended`` (seconds since 1970) are in the last row of a stream only; streams that are folded
        side by side share their time by their rows.
        """
        target = self.normalize_target if self.normalize_target is not None else self.task == "regression"
        every, rows = [(m, i) for m in self.models for i in range(len(self.run_seeds))], None
        for name in self.names:
            nth = F.lit(-1) if STREAMS[name].key else F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1)))
            one = prepared(instances(spark, sf_dir, name), STREAMS[name].width, most=self.most).select(F.lit(name).alias("dataset"), nth.alias("nth"), "stream_id", "seq", "x", "y")
            rows = one if rows is None else rows.unionByName(one)
        models, seeds, labels, normalize = dict(self.models), self.run_seeds, self.task == "classification", self.normalize

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("seq").reset_index(drop=True)
            y, std, mean = pdf.y.tolist(), pdf["std"].tolist(), pdf["mean"].tolist()
            algo, params = models[pdf.framework[0]]
            seed, began, pred, error = seeds[int(pdf.run_id[0])], time.time(), [], None
            try:
                x, z = np.stack(pdf.x.to_numpy()), pdf.z.astype("int64" if labels else "float64").tolist()
                maker = KERNELS[algo][0]
                own = {"seed": seed} if seed is not None and "seed" in inspect.signature(maker).parameters else {}
                model = maker(x.shape[1], **params, **own)
                x = x.tolist() if getattr(model, "plain", False) else x
                for i, t in enumerate(z):
                    p = model.predict(x[i])
                    model.learn(x[i], t)
                    pred.append(None if p is None else min(MOST, max(-MOST, float(p) * std[i] + mean[i])))
            except Exception as e:  # the other runs go on
                error = f"{type(e).__name__}: {e}"
            n, more = len(pred), int(error is not None)
            end = [None] * max(0, n + more - 1)
            return pd.DataFrame({
                "framework": pdf.framework[0],
                "dataset": pdf.dataset[0],
                "run_id": pdf.run_id[0],
                "seed": pd.array([seed] * (n + more), dtype="Int64"),
                "stream_id": pdf.stream_id[0],
                "seq": pd.array([*pdf.seq.to_numpy()[:n], *[None] * more], dtype="Int64"),
                "y": [*y[:n], *[None] * more],
                "pred": [*pred, *[None] * more],
                "error": [*end, error],
                "started": [*end, began],
                "ended": [*end, time.time()],
            })

        def alone(maker, params: dict, seed: int | None, x: np.ndarray, z: np.ndarray, bounds: np.ndarray) -> tuple[list, np.ndarray]:
            """Predictions of streams that are folded one after the other, and when each began and the last ended."""
            own, said, clock = {"seed": seed} if seed is not None and "seed" in inspect.signature(maker).parameters else {}, [], [time.time()]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                said += run_rows(maker(x.shape[1], **params, **own), x[a:b], z[a:b])
                clock.append(time.time())
            return said, np.array(clock)

        def side(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
            began, framework, run_id = time.time(), rows["framework"][0].as_py(), rows["run_id"][0].as_py()
            algo, params = models[framework]
            mean, std = rows["mean"].to_numpy(), rows["std"].to_numpy()
            z = pa.compute.cast(rows["z"], pa.int64() if labels else pa.float64()).to_numpy()
            if KERNELS[algo][0] in LOCKSTEP:
                pred, _ = side_by_side(KERNELS[algo][0], params, matrix(rows), z, bounds)
                share = began + (time.time() - began) * bounds / bounds[-1]
                none, times = None, (share[:-1], share[1:])
            else:
                said, clock = alone(KERNELS[algo][0], params, seeds[run_id], matrix(rows), z, bounds)
                pred, none, times = np.array([np.nan if p is None else p for p in said], float), np.array([p is None for p in said]), (clock[:-1], clock[1:])
            pred = cut(pred * std + mean, MOST)
            ends = [np.full(len(rows), np.nan) for _ in range(2)]
            for at, v in zip(ends, times):
                at[bounds[1:] - 1] = v
            times = [pa.array(at, from_pandas=True) for at in ends]
            first = [rows["framework"], rows["dataset"], rows["run_id"], pa.array([seeds[run_id]] * len(rows), type=pa.int64()), rows["stream_id"], rows["seq"], rows["y"]]
            return pa.table([*first, pa.array(pred, mask=none), pa.nulls(len(rows), pa.string()), *times], schema=PREDICTIONS)

        def unmade(rows: pa.Table, bounds: np.ndarray) -> pa.Table | None:
            """A row for each stream, if there is no making the learner of a run."""
            began, framework, run_id = time.time(), rows["framework"][0].as_py(), rows["run_id"][0].as_py()
            algo, params = models[framework]
            try:
                maker, seed = KERNELS[algo][0], seeds[run_id]
                maker(matrix(rows.slice(0, 1)).shape[1], **params, **({"seed": seed} if seed is not None and "seed" in inspect.signature(maker).parameters else {}))
            except Exception as e:
                if rows["z"].null_count:
                    return None
                one, n = rows.take(bounds[:-1]), len(bounds) - 1
                alike = [pa.array([v] * n, type=t) for v, t in ((f"{type(e).__name__}: {e}", pa.string()), (began, pa.float64()), (time.time(), pa.float64()))]
                return pa.table([one["framework"], one["dataset"], one["run_id"], pa.array([seeds[run_id]] * n, type=pa.int64()), one["stream_id"], pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.float64())] * 2, *alike], schema=PREDICTIONS)
            return None

        def of_run(rows: pa.Table, bounds: np.ndarray) -> list[pa.Table]:
            if (failed := unmade(rows, bounds)) is not None:
                return [failed]
            try:
                return [side(rows, bounds)]
            except Exception:  # one by one, each with its own faults
                return [pa.Table.from_pandas(run(rows.slice(a, b - a).to_pandas()), schema=PREDICTIONS, preserve_index=False) for a, b in zip(bounds[:-1], bounds[1:])]

        def together(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
            own = list(zip(*[rows.take(bounds[:-1])[k].to_pylist() for k in keys[:-1]]))  # dataset and run of each stream
            firsts, parts = [i for i in range(len(own)) if not i or own[i] != own[i - 1]], []
            for a, b in zip(firsts, [*firsts[1:], len(own)]):
                some, inside, nth = rows.slice(bounds[a], bounds[b] - bounds[a]), bounds[a : b + 1] - bounds[a], own[a][1]
                x = in_range(some["x"], inside) if normalize else some["x"]
                z, mean, std = around_mean(some["y"], inside) if target else (some["y"], pa.array(np.zeros(len(some))), pa.array(np.ones(len(some))))
                some = pa.table({"dataset": some["dataset"], "stream_id": some["stream_id"], "seq": some["seq"], "x": x, "y": some["y"], "z": z, "mean": mean, "std": std})
                for m, i in every if nth < 0 else every[nth : nth + 1]:
                    parts += of_run(some.append_column("framework", pa.repeat(m, len(some))).append_column("run_id", pa.repeat(pa.scalar(i, pa.int32()), len(some))), inside)
            return pa.concat_tables([p.replace_schema_metadata() for p in parts])

        keys = ("dataset", "nth", "stream_id")
        return in_chunks(rows, keys, together, "framework string, dataset string, run_id int, seed long, stream_id string, seq long, y double, pred double, error string, started double, ended double")

    def runs(self, preds: DataFrame) -> DataFrame:
        """A row per run: rows, metrics, busy seconds, rows a second, first start, last end, status and place in the suite."""
        key = ["framework", "dataset", "run_id"]
        spent = (F.col("ended") - F.col("started")).alias("spent")
        if self.task == "classification":  # all that runs have is in the counts of their labels and predictions: one pass over the rows
            rows = stored(preds.groupBy(*RUN, "y", "pred").agg(F.count("seq").alias("c"), F.min("error").alias("error"), F.sum(spent).alias("spent"), F.min("started").alias("started"), F.max("ended").alias("ended")))
            measured = metrics.of_pairs(rows.where("c > 0").select(*key, "y", "pred", "c"))
        else:
            rows, measured = preds.withColumn("spent", spent), metrics.regression(preds.where("seq is not null"), *key)
        told = rows.groupBy(*RUN).agg(F.min("error").alias("error"), F.sum("spent").alias("total_time_s"), F.min("started").alias("started_at"), F.max("ended").alias("finished_at"))
        out = told.join(measured, key, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("long")))
        place = {(m, d): i * len(self.names) + j for i, m in enumerate(self.models) for j, d in enumerate(self.names)}
        nth = F.create_map(*[F.lit(v) for (m, d), i in place.items() for v in (f"{m}|{d}", i)])
        index = F.col("run_id") * len(place) + nth[F.concat_ws("|", "framework", "dataset")] + 1
        return out.withColumns({
            "task": F.lit(self.task),
            "rows_per_s": F.when(F.col("total_time_s") > 0, F.col("n_samples") / F.col("total_time_s")),
            "status": F.when(F.col("error").isNull(), "finished").otherwise("failed"),
            "task_index": index.cast("int"),
            "task_total": F.lit(len(place) * len(self.run_seeds)),
        })

    def windows(self, preds: DataFrame, only: str | None = None) -> DataFrame:
        """Metrics per run, stream and window of ``window`` rows, the partial last one included; of classes all, or ``only`` accuracy, which takes one exchange."""
        rows = preds.where("seq is not null").withColumn("window_no", F.floor((F.col("seq") - 1) / self.window))
        by = ("framework", "dataset", "run_id", "stream_id", "window_no")
        if self.task == "regression":
            return metrics.regression(rows, *by)
        return metrics.accuracy(rows, *by) if only == "accuracy" else metrics.classification(rows, *by)


def ranking(runs: DataFrame, task: str) -> DataFrame:
    """Per dataset the frameworks by the mean of the primary metric over runs that didn't fail; equal means share a rank."""
    m = PRIMARY[task]
    board = runs.where("error is null").groupBy("dataset", "framework").agg(F.count("*").alias("n_runs"), F.round(F.avg(m), 6).alias("score"))
    return board.withColumn("rank", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("score"))))  # a row per framework


def events(runs: DataFrame) -> DataFrame:
    """Two rows per run, started and finished, with its place, its status and, when finished, its time of the event."""
    both = F.explode(F.array(F.struct(F.lit("task_started").alias("event"), F.col("started_at").alias("at"), F.lit(None).cast("string").alias("state")), F.struct(F.lit("task_finished").alias("event"), F.col("finished_at").alias("at"), F.col("status").alias("state"))))
    return runs.select(*RUN, "task_index", "task_total", both.alias("e")).select(*RUN, "task_index", "task_total", "e.*")


def aggregated(runs: DataFrame, task: str) -> DataFrame:
    """Means, deviations and ends of all metrics per framework and dataset, with rows, seeds and the errors of failed runs; no runs is an error."""
    if not runs.take(1):
        raise ValueError("there are no runs")
    more = runs.groupBy("framework", "dataset").agg(F.max(F.when(F.col("error").isNull(), F.col("n_samples"))).alias("n_samples"), F.sort_array(F.collect_set("seed")).alias("seeds"), F.sort_array(F.collect_list("error")).alias("errors"))
    return metrics.summary(runs, METRICS[task]).join(more.withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("long"))), ["framework", "dataset"])
