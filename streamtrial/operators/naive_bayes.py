"""Gaussian naive Bayes, test then train, as running sums in blocks: no task holds a stream."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.functions import scalar
from streamtrial.operators.fold import matrix, whole_groups
from streamtrial.operators.scan import LEAST_BLOCK

FLOOR = log(1e-300)
#: Rows whose sums a task holds at once, rounded up to whole blocks.
CHUNK_ROWS = 30_000


def scores(classes: tuple[int, ...], width: int, shift: list[str]) -> list[str]:
    """Log posterior (up to a constant) per class from n<c>, s<c>_<f>, q<c>_<f> and f<f>; null for a class without rows."""
    total = "(" + " + ".join(f"n{c}" for c in classes) + ")"
    parts = {c: " + ".join(f"({scalar.gaussian_log_density(f'(f{f} - {shift[f]})', f'n{c}', f's{c}_{f}', f'q{c}_{f}')})" for f in range(width)) for c in classes}
    return [f"CASE WHEN n{c} > 0 THEN ln(CAST(n{c} AS DOUBLE) / {total}) + {parts[c]} END" for c in classes]


def measures(classes: tuple[int, ...], width: int, shift: list[str]) -> dict[str, str]:
    """The running sums that ``scores`` needs, as SQL text."""
    out = {}
    for c in classes:
        out[f"n{c}"] = f"CASE WHEN y = {c} THEN 1 ELSE 0 END"
        for f in range(width):
            d = f"(f{f} - {shift[f]})"
            out[f"s{c}_{f}"] = f"CASE WHEN y = {c} THEN {d} ELSE 0.0 END"
            out[f"q{c}_{f}"] = f"CASE WHEN y = {c} THEN {d} * {d} ELSE 0.0 END"
    return out


def flat(df: DataFrame, width: int) -> DataFrame:
    return df.select("stream_id", "seq", "y", *[F.col("x")[f].alias(f"f{f}") for f in range(width)])


def naive_bayes(df: DataFrame, classes: tuple[int, ...], width: int, proba: bool = False) -> DataFrame:
    """stream_id, seq, y, pred (and p<c>); -1 before any row, ties to the smaller class.

    Sums are taken around the features' means, which only keeps digits: the result doesn't depend on them.
    """
    top = df.agg(F.max("seq").alias("m"), *[F.avg(F.col("x")[f]).alias(f"a{f}") for f in range(width)]).first()
    block = max(LEAST_BLOCK, isqrt(top.m or 1))
    shift = [float(top[f"a{f}"] or 0.0) for f in range(width)]
    sums = measures(classes, width, [repr(v) + "D" for v in shift])
    # as in ``scan``: totals of blocks, summed over the blocks before; inside a block the sums are numpy's, as one window of Spark for each costs far more
    rows = df.select("stream_id", "seq", "y", "x", F.floor((F.col("seq") - 1) / block).alias("_blk")).repartition("stream_id", "_blk").sortWithinPartitions("stream_id", "_blk", "seq")
    totals = rows.select("stream_id", "_blk", "y", *[F.col("x")[f].alias(f"f{f}") for f in range(width)]).groupBy("stream_id", "_blk").agg(*[F.sum(F.expr(v).cast("double")).alias(k) for k, v in sums.items()])
    earlier = Window.partitionBy("stream_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("stream_id", "_blk", F.array(*[F.coalesce(F.sum(k).over(earlier), F.lit(0.0)) for k in sums]).alias("_start")).where("_blk > 0")
    first = F.when(F.col("seq") == F.col("_blk") * block + 1, F.col("_start"))  # a block's first row brings what was before it
    rows = rows.join(before, ["stream_id", "_blk"], "left").select("stream_id", "_blk", "seq", "y", "x", first.alias("_start"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, bounds in whole_groups(batches, ("stream_id", "_blk"), CHUNK_ROWS):
            z = _scored(some, bounds, classes, shift)
            seen = np.isfinite(z) | np.isnan(z)
            pred = np.where(seen.any(1), np.array(classes)[z.argmax(1)], -1)
            out = some.select(["stream_id", "seq", "y"]).append_column("pred", pa.array(pred, pa.int32()))
            if proba:
                p = np.exp(np.where(seen, z, -1e308) - np.where(seen, z, -1e308).max(1, keepdims=True))
                for i, c in enumerate(classes):
                    out = out.append_column(f"p{c}", pa.array(p[:, i] / p.sum(1)))
            yield from out.to_batches(max_chunksize=10_000)

    kind = dict(df.dtypes)["y"]
    schema = f"stream_id string, seq long, y {kind}, pred int" + "".join(f", p{c} double" for c in classes) * proba
    return rows.sortWithinPartitions("stream_id", "_blk", "seq").mapInArrow(each, schema)


def _scored(rows: pa.Table, bounds: np.ndarray, classes: tuple[int, ...], shift: list[float]) -> np.ndarray:
    """``scores`` of the rows (by classes) of whole blocks between ``bounds``; -inf for a class without rows before."""
    x, width = matrix(rows) - np.array(shift), len(shift)
    null = rows["x"].combine_chunks().flatten().is_null().to_numpy(zero_copy_only=False).reshape(x.shape)
    y = rows["y"].to_numpy()
    known = np.where(null, 0.0, x)
    own = np.zeros((len(classes), 1 + 2 * width, len(x)))
    for i, c in enumerate(classes):
        at = np.flatnonzero(y == c)
        own[i, 0, at] = 1.0
        own[i, 1::2, at] = known[at]
        own[i, 2::2, at] = known[at] * known[at]
    own = own.reshape(-1, len(x))
    ran, starts = np.zeros_like(own), rows["_start"].take(bounds[:-1]).to_pylist()
    for a, b, start in zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts):
        np.cumsum(own[:, a : b - 1], axis=1, out=ran[:, a + 1 : b])
        if start is not None:
            ran[:, a:b] += np.array(start)[:, None]
    ran = ran.reshape(len(classes), 1 + 2 * width, len(x))
    total, out = ran[:, 0].sum(0), np.empty((len(x), len(classes)))
    with np.errstate(all="ignore"):
        for i in range(len(classes)):
            n = ran[i, 0]
            z = np.log(n / total)
            for f in range(width):
                s, q, v = ran[i, 1 + 2 * f], ran[i, 2 + 2 * f], x[:, f]
                mean, var = s / n, (q - s * s / n) / (n - 1)
                d = v - mean
                density = -0.5 * d * d / var - 0.5 * np.log(2 * np.pi * var)
                density = np.where(density < FLOOR, FLOOR, density)
                density = np.where(var <= 1e-12 * q / n, np.where(np.abs(d) <= 1e-9, 0.0, FLOOR), density)
                z = z + np.where((n < 2) | null[:, f], FLOOR, density)
            out[:, i] = np.where(n > 0, z, -np.inf)
    return out


def fit(df: DataFrame, width: int) -> DataFrame:
    """y, n, mean<f>, var<f>: the model of all rows, one aggregation."""
    rows = flat(df, width)
    return rows.groupBy("y").agg(F.count("*").alias("n"), *[a for f in range(width) for a in (F.avg(f"f{f}").alias(f"mean{f}"), F.coalesce(F.var_samp(f"f{f}"), F.lit(0.0)).alias(f"var{f}"))])
