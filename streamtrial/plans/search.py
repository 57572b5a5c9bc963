"""Searches over pipelines on keyed streams, and the tables of what they search in.

A strategy (``operators.automl``) is a kernel of the fold, so one job runs it on every stream with every seed: a group per
(stream, seed), each with its own pool, windows, drift detector and draws, and nothing on the driver. A hold-out search has a
group per stream, whose members share what their scalers make of a row. Memory of a task: the rows of a chunk of whole streams and one pool.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtrial.operators import automl
from streamtrial.operators.fold import KERNELS, dealt, each_alone, goes_together, in_chunks, matrix, run_rows, told
from streamtrial.operators.pipelines import LEARNERS, SCALERS, SELECTORS, Config, Dice, preset, usual


def _seeded(df: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    return df.select("stream_id", "seq", "x", "y").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def _made(strategy: str, width: int, params: dict | None, seed: int):
    return KERNELS[strategy][0](width, **(params or {}), seed=int(seed))


def searched(df: DataFrame, strategy: str, params: dict | None = None, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """seed, stream_id, seq, y, pred of a strategy on every stream with every seed; ``seq`` gives the order of a stream."""
    kind = "int" if KERNELS[strategy][1] == "classification" else "double"

    def run(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        pred = each_alone(rows, bounds, lambda at, width: _made(strategy, width, params, rows["seed"][at].as_py()))
        return told(rows, ["seed", "stream_id", "seq", "y"], kind, pred)

    return in_chunks(_seeded(df, seeds), ("stream_id", "seed"), run, f"seed int, stream_id string, seq long, y {kind}, pred {kind}", goes_together(KERNELS[strategy][0]))


def search_log(df: DataFrame, strategy: str, params: dict | None = None, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """seed, stream_id, seq, event, config, score: what a strategy did on every stream: windows, falls, drift, mutants, promotions."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x = np.stack(pdf.x.to_numpy())
        model = _made(strategy, x.shape[1], params, pdf.seed.iloc[0])
        run_rows(model, x, pdf.y.to_numpy())
        out = pd.DataFrame(model.log, columns=["seq", "event", "config", "score"])
        return out.assign(seed=int(pdf.seed.iloc[0]), stream_id=pdf.stream_id.iloc[0])[["seed", "stream_id", "seq", "event", "config", "score"]]

    return dealt(_seeded(df, seeds), "stream_id", "seed").groupBy("stream_id", "seed").applyInPandas(run, "seed int, stream_id string, seq long, event string, config string, score double")


def holdout_configs(budget: int, seed: int = 0) -> list[Config]:
    dice = Dice("holdout", seed)
    return [preset("classification", dice) for _ in range(budget)]


def holdout_search(df: DataFrame, budget: int = 20, seed: int = 0, share: float = 0.8) -> DataFrame:
    """stream_id, member, config, score, best: accuracy of random pipelines on the rows of each stream after the first ``share``.

    Only the first rows are learned from. The best is the first of equals; streams below four rows have no rows here.
    """
    configs = holdout_configs(budget, seed)
    names = [c.name for c in configs]

    def run(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        x, y, ids, scores = matrix(rows), rows["y"].to_numpy(), [], []
        starts = [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b - a >= 4]
        for a, b in starts:
            scores.append(automl.held_out(x[a:b], y[a:b], configs, x.shape[1], share)[0])
        scores = np.array(scores, dtype=float).reshape(-1, budget)
        ids = rows["stream_id"].take(pa.array(np.repeat([a for a, _ in starts], budget).astype(np.int64)))
        best = np.arange(budget) == scores.argmax(1)[:, None]  # the first of equals
        return pa.table({"stream_id": ids, "member": np.tile(np.arange(budget, dtype=np.int32), len(starts)), "config": pa.array(names * len(starts), pa.string()), "score": scores.ravel(), "best": best.ravel()})

    return in_chunks(df.select("stream_id", "seq", "x", "y"), ("stream_id",), run, "stream_id string, member int, config string, score double, best boolean")


# --- tables of the search space --------------------------------------------------------------------------

def space_table(spark: SparkSession, task: str) -> DataFrame:
    """part (scaler, selector, learner), name, param, ord, value (text), usual: the grids as a table; parts without parameters have one row without them."""
    rows = []
    for part, table in (("scaler", SCALERS), ("selector", SELECTORS), ("learner", LEARNERS)):
        for name, grid in table[task].items():
            common = dict(usual(name, grid))
            rows += [(part, name, k, i, str(v), v == common[k]) for k, values in grid.items() for i, v in enumerate(values)] or [(part, name, None, None, None, None)]
    return spark.createDataFrame(rows, "part string, name string, param string, ord int, value string, usual boolean")


def combinations(space: DataFrame) -> DataFrame:
    """scaler, selector (null: none), learner: all combinations of a space table."""
    names = lambda part: space.where(F.col("part") == part).select(F.col("name").alias(part)).distinct()
    with_none = names("selector").union(names("selector").limit(1).select(F.lit(None).cast("string")))
    return names("scaler").crossJoin(with_none).crossJoin(names("learner"))  # a few dozen rows


def neighbours(config: DataFrame, space: DataFrame) -> DataFrame:
    """name, param, ord, turn, to_ord, to_value: where a search may go from each parameter of ``config`` (name, param, ord): same, upper, lower."""
    ends = space.where("param is not null").groupBy("name", "param").agg(F.max("ord").alias("last"))
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(d).alias("d")) for t, d in (("same", 0), ("upper", 1), ("lower", -1))]))
    moved = config.join(ends, ["name", "param"]).withColumn("t", turns).select("name", "param", "ord", "t.turn", F.greatest(F.lit(0), F.least(F.col("last"), F.col("ord") + F.col("t.d"))).alias("to_ord"))
    values = space.select("name", "param", F.col("ord").alias("to_ord"), F.col("value").alias("to_value"))
    return moved.join(values, ["name", "param", "to_ord"]).select("name", "param", "ord", "turn", "to_ord", "to_value")
