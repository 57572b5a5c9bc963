"""Order-dependent learners: a sequential recurrence per key, fanned out over (stream, configuration).

Test then train: each row is predicted by what the rows before it have taught, then learned. One key is
one group; scale comes from many streams, configurations and seeds. The linear learners fold all streams that a
task holds side by side (``lockstep``), chunk by chunk, as a group of its own costs more than a short stream's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.operators import grove, kernels, pool, trees
from streamtrial.operators.lockstep import LOCKSTEP, side_by_side

#: Rows that a task folds at once, rounded up to whole streams.
CHUNK_ROWS = 200_000
#: The same for learners whose streams go together, and the most streams that do so at once.
TOGETHER_ROWS, TOGETHER = 3_200_000, 512

#: name -> (maker, task)
KERNELS = {
    "perceptron": (kernels.Perceptron, "classification"),
    "logistic": (kernels.Logistic, "classification"),
    "softmax": (kernels.Softmax, "classification"),
    "passive_aggressive": (kernels.PassiveAggressive, "classification"),
    "hoeffding_tree": (trees.HoeffdingTree, "classification"),
    "efdt": (trees.extremely_fast, "classification"),
    "gradient_tree": (trees.GradientLeaf, "classification"),
    "naive_bayes": (pool.NaiveBayes, "classification"),
    "knn": (pool.Nearest, "classification"),
    "bagged_naive_bayes": (pool.Bagged, "classification"),
    "linear": (kernels.LinearSgd, "regression"),
    "adaptive_line": (kernels.AdaptiveLine, "regression"),
    "bayesian_linear": (kernels.BayesianLinear, "regression"),
    "passive_aggressive_reg": (kernels.PassiveAggressiveLine, "regression"),
    "hoeffding_tree_reg": (trees.HoeffdingRegressor, "regression"),
    "knn_reg": (pool.NearestMean, "regression"),
}


def goes_together(maker) -> bool:
    """Whether streams of a learner are worth folding together, beyond the linear ones."""
    return getattr(maker, "together", False)


def dealt(df: DataFrame, *keys: str, together: bool = False) -> DataFrame:
    """Rows dealt by key to four times as many tasks as shuffles have partitions; ``together``: to twice as many as there are cores, so that a task has many streams.

    A fold costs time, not bytes: with its groups dealt to a set number of tasks adaptive execution doesn't join them by their small size.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, min(8, parts)) if together else 4 * parts, *keys)


def register(name: str, maker, task: str) -> None:
    """Adds a learner: ``maker(width, **params)`` with ``predict(x)`` and ``learn(x, y)``."""
    KERNELS[name] = (maker, task)


def run_rows(model, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list:
    """Predictions of a model that learns each row after predicting it, ``weight`` times; a plain one gets its rows as lists."""
    if getattr(model, "plain", False):
        x, y = np.asarray(x, float).tolist(), np.asarray(y).tolist()
        if weight is None and hasattr(model, "run"):
            return model.run(x, y)
        if weight is None and hasattr(model, "step"):
            return list(map(model.step, x, y))
    out = []
    for i, row in enumerate(x):
        out.append(model.predict(row))
        for _ in range(1 if weight is None else int(weight[i])):
            model.learn(row, y[i])
    return out


def bounds_of(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups of sorted rows start, and the end."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for k in keys:
        codes = rows[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), len(rows))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], chunk: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held, n, least = [], 0, chunk
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= least:
            rows = pa.Table.from_batches(held).combine_chunks()
            bounds = bounds_of(rows, keys)
            if len(bounds) > 2:
                yield rows.slice(0, bounds[-2]), bounds[:-1]
            rows = rows.slice(bounds[-2])
            held, n = rows.to_batches(), len(rows)
            least = max(chunk, 2 * n)  # a long stream isn't looked through with each batch
    if n:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, bounds_of(rows, keys)


def in_chunks(df: DataFrame, keys: tuple[str, ...], run: Callable, schema: str, together: bool = False) -> DataFrame:
    """``run(rows, bounds)``, an Arrow table of whole groups sorted by keys and ``seq`` and where they start, to tables of ``schema``; ``together``: of many groups."""
    chunk = TOGETHER_ROWS if together else CHUNK_ROWS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, keys, chunk):
            yield from run(rows, bounds).to_batches(max_chunksize=10_000)

    return dealt(df, *keys, together=together).sortWithinPartitions(*keys, "seq").mapInArrow(each, schema)


def matrix(rows: pa.Table, column: str = "x") -> np.ndarray:
    """A column of lists of one length as rows by features; null is NaN."""
    values = rows[column].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def told(rows: pa.Table, columns: list[str], kind: str, pred) -> pa.Table:
    return rows.select(columns).append_column("pred", pa.array(pred, type=pa.int32() if kind == "int" else pa.float64()))


def each_alone(rows: pa.Table, bounds: np.ndarray, made: Callable, fold: Callable = run_rows) -> list:
    """``fold`` of every group's rows between ``bounds``, one after the other; ``made(place of the group's first row, width)`` is its learner."""
    x, y, out = matrix(rows), rows["y"].to_numpy(), []
    ends = bounds.tolist()
    if fold is run_rows and len(ends) > 1 and goes_together(type(made(0, x.shape[1]))):
        for i in range(0, len(ends) - 1, TOGETHER):
            some = ends[i : i + TOGETHER + 1]
            for said in grove.together([made(a, x.shape[1]).going(x[a:b], y[a:b]) for a, b in zip(some[:-1], some[1:])]):
                out += said
        return out
    for a, b in zip(ends[:-1], ends[1:]):
        out += fold(made(a, x.shape[1]), x[a:b], y[a:b])
    return out


def _together(maker, params: dict, kind: str, proba: bool, rows: pa.Table, bounds: np.ndarray) -> pa.Table:
    pred, shares = side_by_side(maker, params, matrix(rows), rows["y"].to_numpy(), bounds, proba=proba)
    out = told(rows, ["stream_id", "seq", "y"], kind, pred)
    return out.append_column("proba", pa.array([list(s.items()) for s in shares], type=pa.map_(pa.int32(), pa.float64()))) if proba else out


def _alone(maker, params: dict, kind: str, proba: bool, rows: pa.Table, bounds: np.ndarray) -> pa.Table:
    def both(model, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        if getattr(model, "plain", False):
            x, y = x.tolist(), y.tolist()
        out = []
        for row, label in zip(x, y):
            out.append((model.predict(row), model.proba(row)))
            model.learn(row, label)
        return out

    said = each_alone(rows, bounds, lambda _, width: maker(width, **params), both if proba else run_rows)
    out = told(rows, ["stream_id", "seq", "y"], kind, [p for p, _ in said] if proba else said)
    return out.append_column("proba", pa.array([list(s.items()) for _, s in said], type=pa.map_(pa.int32(), pa.float64()))) if proba else out


def prequential(df: DataFrame, algo: str, params: dict | None = None, proba: bool = False) -> DataFrame:
    """stream_id, seq, y, pred (and proba, class to probability) of one learner on every stream of ``df``."""
    maker, task = KERNELS[algo]
    kind = "int" if task == "classification" else "double"
    schema = f"stream_id string, seq long, y {kind}, pred {kind}" + ", proba map<int,double>" * proba

    fold = partial(_together if maker in LOCKSTEP else _alone, maker, params or {}, kind, proba)
    return in_chunks(df.select("stream_id", "seq", "x", "y"), ("stream_id",), fold, schema, goes_together(maker) and not proba)


def prequential_each(df: DataFrame, algos: tuple[str, ...], proba: bool = False) -> DataFrame:
    """member (place in ``algos``), stream_id, seq, y, pred (and proba) of several learners of one task: streams are numbered, dealt and sorted once for all of them."""
    kind = "int" if KERNELS[algos[0]][1] == "classification" else "double"
    schema = f"member int, stream_id string, seq long, y {kind}, pred {kind}" + ", proba map<int,double>" * proba
    makers = [KERNELS[a][0] for a in algos]

    def run(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        parts = [(_together if m in LOCKSTEP else _alone)(m, {}, kind, proba, rows, bounds).replace_schema_metadata() for m in makers]
        return pa.concat_tables([p.add_column(0, "member", pa.array(np.full(len(p), i, dtype=np.int32))) for i, p in enumerate(parts)])

    return in_chunks(df.select("stream_id", "seq", "x", "y"), ("stream_id",), run, schema)


def sweep(df: DataFrame, configs: list[tuple[str, str, dict]]) -> DataFrame:
    """config_id, stream_id, seq, y, pred, error: every configuration (id, algo, params) on every stream.

    A configuration that fails gives one row per stream with the error's text; the others go on.
    """
    task = KERNELS[configs[0][1]][1] if configs[0][1] in KERNELS else "classification"
    kind = "int" if task == "classification" else "double"
    table = {c[0]: c for c in configs}
    ids = F.explode(F.array(*[F.lit(c[0]) for c in configs]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        _, algo, params = table[pdf.config_id.iloc[0]]
        out = pdf[["config_id", "stream_id", "seq", "y"]].copy()
        try:
            x = np.stack(pdf.x.to_numpy())
            out["pred"] = run_rows(KERNELS[algo][0](x.shape[1], **params), x, pdf.y.to_numpy())
            out["error"] = None
        except Exception as e:
            out = out.head(1)
            out["pred"], out["error"] = None, f"{type(e).__name__}: {e}"
        return out

    def one(rows: pa.Table) -> pa.Table:
        out = run(rows.to_pandas())
        return pa.table({"config_id": out.config_id, "stream_id": out.stream_id, "seq": out.seq, "y": out.y, "pred": out.pred, "error": out.error}, schema=shape)

    def together(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        ids, parts = rows["config_id"].to_pylist(), []
        firsts = [i for i, b in enumerate(bounds[:-1]) if not i or ids[b] != ids[bounds[i - 1]]]
        for a, b in zip(firsts, [*firsts[1:], len(bounds) - 1]):  # the streams of a configuration
            some = rows.slice(bounds[a], bounds[b] - bounds[a])
            _, algo, params = table[ids[bounds[a]]]
            try:
                pred, _ = side_by_side(KERNELS[algo][0], params, matrix(some), some["y"].to_numpy(), bounds[a : b + 1] - bounds[a])
                parts.append(told(some, ["config_id", "stream_id", "seq", "y"], kind, pred).append_column("error", pa.nulls(len(some), pa.string())))
            except Exception:  # no such form, or a fault in some stream: one by one
                parts += [one(rows.slice(bounds[i], bounds[i + 1] - bounds[i])) for i in range(a, b)]
        return pa.concat_tables([p.cast(shape) for p in parts])

    number = pa.int32() if kind == "int" else pa.float64()
    shape = pa.schema([("config_id", pa.string()), ("stream_id", pa.string()), ("seq", pa.int64()), ("y", number), ("pred", number), ("error", pa.string())])
    rows = df.select("stream_id", "seq", "x", "y").withColumn("config_id", ids)
    return in_chunks(rows, ("config_id", "stream_id"), together, f"config_id string, stream_id string, seq long, y {kind}, pred {kind}, error string")
