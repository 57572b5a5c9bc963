"""Sliding-window nearest neighbours: each row against the ``window`` rows before it in its stream.

Rows are cut into blocks as long as the window, so the rows before a row lie in its block or the one before. Each
row goes to both blocks that may ask for it; a task holds two blocks and works on them as matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that are asked for at once.
STEP = 32


def minkowski(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``; features are added in their order."""
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d = np.abs(a[:, f, None] - b[None, :, f])
        total += d if p == 1 else d * d if p == 2 else d**p
    return total if p == 1 else np.sqrt(total) if p == 2 else total ** (1 / p)


def _blocks(df: DataFrame, window: int) -> DataFrame:
    own = F.floor((F.col("seq") - 1) / window)
    roles = F.array(F.struct(own.alias("blk"), F.lit(True).alias("asks")), F.struct((own + 1).alias("blk"), F.lit(False).alias("asks")))
    return df.withColumn("_r", F.explode(roles)).select("*", F.col("_r.blk").alias("blk"), F.col("_r.asks").alias("asks")).drop("_r")


def _near(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which distances of each row are among its k least, ties at the border included; and the rows that have more than k for it."""
    kk = min(k, d.shape[1])
    bound = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    taken = (d <= bound[:, None]) & np.isfinite(d)
    return taken, taken.sum(axis=1) > k


def nearest(df: DataFrame, answer: Callable, schema: str, k: int, window: int, p: float) -> DataFrame:
    """``answer(labels, distances, taken)`` of each row's k nearest earlier rows, ``taken`` a matrix of rows by candidates; ties go to the
    smaller label, then the earlier row.

    ``df``: stream_id, seq, x, y. A row without earlier ones has nothing taken. A step works on some rows and only the
    candidates that lie in the window of one of them.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        ask = pdf[pdf.asks]
        out = ask[["stream_id", "seq", "y"]].copy()
        if not len(ask):
            return out.assign(pred=ask.y)
        x, seq, y = np.stack(pdf.x.to_numpy()), pdf.seq.to_numpy(), pdf.y.to_numpy()
        asking = np.flatnonzero(pdf.asks.to_numpy())
        pred = []
        for a in range(0, len(asking), STEP):
            rows = asking[a : a + STEP]
            own = slice(int(np.searchsorted(seq, seq[rows[0]] - window)), int(rows[-1]) + 1)
            cx, cseq, cy = x[own], seq[own], y[own]
            d = minkowski(x[rows], cx, p)
            d[(cseq[None, :] >= seq[rows, None]) | (cseq[None, :] < seq[rows, None] - window)] = np.inf
            taken, more = _near(d, k)
            for r in np.flatnonzero(more):
                at = np.flatnonzero(taken[r])
                taken[r, at[np.lexsort((cseq[at], cy[at], d[r, at]))][k:]] = False
            pred.append(answer(cy, d, taken))
        out["pred"] = np.concatenate(pred)
        return out

    return _blocks(df.select("stream_id", "seq", "x", "y"), window).groupBy("stream_id", "blk").applyInPandas(run, schema)


def _vote(labels: np.ndarray, _: np.ndarray, taken: np.ndarray) -> np.ndarray:
    values = np.unique(labels)
    counts = np.stack([taken[:, labels == v].sum(axis=1) for v in values], axis=1)
    return np.where(taken.any(axis=1), values[np.argmax(counts, axis=1)], -1)


def _weighted(targets: np.ndarray, d: np.ndarray, taken: np.ndarray) -> np.ndarray:
    w = np.where(taken, np.where(d <= 1e-10, 1e10, 1 / np.maximum(d, 1e-10)), 0.0)
    total = w.sum(axis=1)
    return np.divide((w * targets[None, :]).sum(axis=1), total, out=np.zeros(len(total)), where=total > 0)


def knn_classify(df: DataFrame, k: int = 5, window: int = 1000, p: float = 2) -> DataFrame:
    """stream_id, seq, y, pred: the majority of the k nearest; -1 before any row, ties to the smaller class."""
    return nearest(df, _vote, "stream_id string, seq long, y int, pred int", k, window, p)


def knn_regress(df: DataFrame, k: int = 5, window: int = 1000, p: float = 2) -> DataFrame:
    """stream_id, seq, y, pred: the mean of the k nearest, weighted by inverse distance; 0 before any row."""
    return nearest(df, _weighted, "stream_id string, seq long, y double, pred double", k, window, p)
