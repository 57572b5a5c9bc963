"""Run tables: ``runs`` (framework, dataset, task, run_id, seed, n_samples, metrics, error) and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_rows(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows as text: metrics with 6 places and blank if the run failed, a missing seed blank, seconds with 4 places if there are any."""
    ok = F.col("error").isNull()
    shown = [F.when(ok & F.col(m).isNotNull(), F.format_string("%.6f", F.col(m))).otherwise("").alias(m) for m in metrics]
    took = [F.format_string("%.4f", F.col("total_time_s")).alias("total_time_s")] if "total_time_s" in runs.columns else []
    return runs.select("run_id", F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("seed"), "framework", "dataset", "task", "n_samples", *shown, *took, F.coalesce("error", F.lit("")).alias("error"))


def to_csv(runs: DataFrame, metrics: list[str], path: str) -> None:
    if not runs.take(1):
        raise RuntimeError("there are no results to write")
    csv_rows(runs, metrics).write.mode("overwrite").csv(path, header=True, emptyValue="")


def to_json(runs: DataFrame, path: str) -> None:
    """One folder per task, dataset and framework."""
    runs.write.mode("overwrite").partitionBy("task", "dataset", "framework").json(path)


def write_tables(runs: DataFrame, aggregate: DataFrame, path: str) -> None:
    """The tables ``runs`` and ``aggregate`` as JSON by task, dataset and framework, and the flat ``summary`` of runs without nesting."""
    to_json(runs, f"{path}/runs")
    aggregate.write.mode("overwrite").partitionBy("dataset", "framework").json(f"{path}/aggregate")
    runs.write.mode("overwrite").json(f"{path}/summary")


def in_order(runs: DataFrame) -> DataFrame:
    return runs.orderBy("run_id", "framework", "dataset")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both result sets; the columns and the task must be the same."""
    if sorted(old.dtypes) != sorted(new.dtypes):
        raise TypeError("results have different columns")
    tasks = [r.task for r in old.select("task").union(new.select("task")).distinct().limit(2).collect()]
    if len(tasks) > 1:
        raise ValueError("results are of different tasks")
    return old.unionByName(new)
