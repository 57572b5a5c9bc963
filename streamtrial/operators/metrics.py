"""Metrics over predictions (stream_id, seq, y, pred), cumulative and per count window.

A null prediction counts as a row, not toward the metrics. Macro averages are over all labels seen as truth or
prediction; what is undefined counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 1000


def window_no(window: int = WINDOW) -> Column:
    return F.floor((F.col("seq") - 1) / window).alias("window_no")


def classification(preds: DataFrame, *by) -> DataFrame:
    """n_samples and accuracy, macro precision, recall and F1 per group."""
    keys = [b if isinstance(b, Column) else F.col(b) for b in by]
    return of_pairs(preds.groupBy(*keys, "y", "pred").agg(F.count("*").alias("c")))


def of_pairs(pairs: DataFrame) -> DataFrame:
    """The same from the counts ``c`` of labels and predictions per group, which are read once."""
    names = [c for c in pairs.columns if c not in ("y", "pred", "c")]
    y, pred, c, none = F.col("y"), F.col("pred"), F.col("c"), F.lit(0).cast("long")
    truth = F.struct(y.alias("label"), none.alias("p"), c.alias("t"), F.when(y == pred, c).otherwise(0).alias("tp"), none.alias("unsaid"))
    said = F.struct(pred.alias("label"), c.alias("p"), none.alias("t"), none.alias("tp"), none.alias("unsaid"))
    nothing = F.struct(F.lit(None).cast(pairs.schema["pred"].dataType).alias("label"), none.alias("p"), none.alias("t"), none.alias("tp"), c.alias("unsaid"))
    sides = pairs.select(*names, F.explode(F.when(pred.isNull(), F.array(nothing)).otherwise(F.array(truth, said))).alias("s")).select(*names, "s.*")
    labels = sides.groupBy(*names, "label").agg(*[F.sum(v).alias(v) for v in ("p", "t", "tp", "unsaid")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    prec, rec = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("t"))
    known = lambda v: F.when(F.col("p") + F.col("t") > 0, v)
    return labels.groupBy(*names).agg(
        (F.sum("t") + F.sum("unsaid")).alias("n_samples"),
        F.when(F.sum("t") > 0, F.sum("tp") / F.sum("t")).alias("accuracy"),
        F.avg(known(prec)).alias("precision"),
        F.avg(known(rec)).alias("recall"),
        F.avg(known(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0))).alias("f1"),
    )


def accuracy(preds: DataFrame, *by) -> DataFrame:
    """n_samples and accuracy per group, in one pass."""
    known = F.col("pred").isNotNull()
    hits = F.sum(F.when(known, F.when(F.col("y") == F.col("pred"), 1).otherwise(0)))
    return preds.groupBy(*by).agg(F.count("*").alias("n_samples"), F.when(F.count("pred") > 0, hits / F.count("pred")).alias("accuracy"))


def regression(preds: DataFrame, *by) -> DataFrame:
    """n_samples, mae, rmse, r2 (0 if the target doesn't vary) per group."""
    known = F.col("pred").isNotNull()
    e = F.when(known, F.col("y") - F.col("pred"))
    own = F.when(known, F.col("y"))
    total = F.var_pop(own) * F.count(own)
    return preds.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(0.0).alias("r2"))


def complete_windows(preds: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mean accuracy over whole windows only."""
    per = preds.groupBy("stream_id", window_no(window)).agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("pred")).cast("int")).alias("a")).where(F.col("n") == window)
    return per.groupBy("stream_id").agg(F.count("*").alias("windows"), F.avg("a").alias("accuracy"))


def trend(preds: DataFrame, window: int = WINDOW, ends: int = 5) -> DataFrame:
    """Mean window accuracy in the first and second half, and in the first and last windows."""
    per = preds.groupBy("stream_id", window_no(window)).agg(F.avg((F.col("y") == F.col("pred")).cast("int")).alias("a"))
    n = per.groupBy("stream_id").agg((F.max("window_no") + 1).alias("n"))
    at, rows = F.col("window_no"), per.join(n, "stream_id")
    mean = lambda c: F.avg(F.when(c, F.col("a")))
    return rows.groupBy("stream_id").agg(mean(2 * at < F.col("n")).alias("first_half"), mean(2 * at >= F.col("n")).alias("second_half"), mean(at < ends).alias("first"), mean(at >= F.col("n") - ends).alias("last"))


def majority(df: DataFrame) -> DataFrame:
    """The most frequent label (the smallest of equals) and its share: what a constant model reaches."""
    counts = df.groupBy("stream_id", "y").agg(F.count("*").alias("c"))
    return counts.groupBy("stream_id").agg(F.max_by("y", F.struct("c", -F.col("y"))).alias("label"), (F.max("c") / F.sum("c")).alias("share"))


def summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per framework and dataset: runs, ok, failed, and mean, deviation, least and greatest of finite values of runs that didn't fail."""
    def of(m: str) -> list[Column]:
        v = F.when(F.col("error").isNull() & ~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))
        return [F.round(F.avg(v), 6).alias(f"{m}_mean"), F.round(F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0), 6).alias(f"{m}_std"), F.round(F.min(v), 6).alias(f"{m}_min"), F.round(F.max(v), 6).alias(f"{m}_max")]

    return runs.groupBy("framework", "dataset").agg(F.count("*").alias("n_runs"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), *[c for m in metrics for c in of(m)])


def mean_curves(windows: DataFrame) -> DataFrame:
    """Mean and deviation of learning curves per window, cut to the shortest run."""
    shortest = windows.groupBy("framework", "dataset", "run_id").agg(F.max("window_no").alias("m")).groupBy("framework", "dataset").agg(F.min("m").alias("m"))
    rows = windows.join(shortest, ["framework", "dataset"]).where("window_no <= m")
    return rows.groupBy("framework", "dataset", "window_no").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def leaderboard(runs: DataFrame, metric: str) -> DataFrame:
    """A row per run, and a row of means (run_id null) where a framework has several valid runs on a dataset."""
    one = runs.select("framework", "dataset", F.col("run_id").cast("string").alias("run_id"), F.col(metric).alias("score"))
    valid = runs.where("error is null").groupBy("framework", "dataset").agg(F.count("*").alias("c"), F.avg(metric).alias("score")).where("c > 1")
    return one.unionByName(valid.select("framework", "dataset", F.lit("mean").alias("run_id"), "score"))
