"""Online bagging and votes over the predictions of members (member, stream_id, seq, y, pred)."""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtrial.operators.fold import KERNELS, dealt, in_chunks, matrix, run_rows, told
from streamtrial.operators.lockstep import LOCKSTEP, side_by_side


def _steps(rate: float) -> list[tuple[float, int]]:
    """(least u, draw) of the inverse distribution function."""
    out, p, total = [], exp(-rate), exp(-rate)
    for k in range(1, int(rate + 8 * rate**0.5) + 8):
        out.append((total, k))
        p *= rate / k
        total += p
    return out


def poisson(rate: float, *keys: Column) -> Column:
    """A Poisson draw from a hash of the keys: the same for the same keys, on every engine that has md5."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0

    def draw(v: Column) -> Column:
        out = F.lit(0)
        for least, k in _steps(rate):
            out = F.when(v >= least, k).otherwise(out)
        return out

    return F.transform(F.array(u), draw)[0]  # one digest a row, not one for each step


def poisson_sql(rate: float, key: str) -> str:
    """The same draw as ANSI SQL; ``key``: text of the keys, joined by bars."""
    u = f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"
    return "CASE " + " ".join(f"WHEN {u} >= {least!r} THEN {k}" for least, k in reversed(_steps(rate))) + " ELSE 0 END"


def bagging(df: DataFrame, algo: str, members: int, rate: float = 6.0, params: dict | None = None, seed: int = 0) -> DataFrame:
    """member, stream_id, seq, y, pred: each member learns each row as often as its draw says."""
    maker, task = KERNELS[algo]
    kind = "int" if task == "classification" else "double"
    rows = df.select("stream_id", "seq", "x", "y").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    rows = rows.withColumn("times", poisson(rate, F.lit(seed), F.col("member"), F.col("stream_id"), F.col("seq")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x = np.stack(pdf.x.to_numpy())
        pdf["pred"] = run_rows(maker(x.shape[1], **(params or {})), x, pdf.y.to_numpy(), pdf.times.to_numpy())
        return pdf[["member", "stream_id", "seq", "y", "pred"]]

    def together(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        pred, _ = side_by_side(maker, params or {}, matrix(rows), rows["y"].to_numpy(), bounds, rows["times"].to_numpy())
        return told(rows, ["member", "stream_id", "seq", "y"], kind, pred)

    schema = f"member int, stream_id string, seq long, y {kind}, pred {kind}"
    if maker in LOCKSTEP:
        return in_chunks(rows, ("member", "stream_id"), together, schema)
    return dealt(rows, "member", "stream_id").groupBy("member", "stream_id").applyInPandas(run, schema)


def recency_vote(preds: DataFrame, members: int) -> DataFrame:
    """The label with the most weight, (member + 1) / members each; ties to the label of the oldest member."""
    votes = preds.groupBy("stream_id", "seq", "y", "pred").agg(F.sum((F.col("member") + 1) / members).alias("w"), F.min("member").alias("oldest"))
    return votes.groupBy("stream_id", "seq", "y").agg(F.max_by("pred", F.struct(F.round("w", 9), -F.col("oldest"))).alias("pred"))


def probability_vote(proba: DataFrame) -> DataFrame:
    """The class with the greatest sum of the members' probabilities; ``proba``: map per member and row; null without any."""
    rows = proba.select("stream_id", "seq", "y", F.explode_outer("proba").alias("class", "p")).groupBy("stream_id", "seq", "y", "class").agg(F.sum("p").alias("p"))
    return rows.groupBy("stream_id", "seq", "y").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("pred"))


def mean_vote(preds: DataFrame) -> DataFrame:
    return preds.groupBy("stream_id", "seq", "y").agg(F.avg("pred").alias("pred"))


def guarded_mean(preds: DataFrame, fallback: DataFrame, members: int, most: float = 1e6) -> DataFrame:
    """Mean weighted by recency over members that haven't diverged (finite, at most ``most``); else ``fallback`` (stream_id, seq, running)."""
    fine = F.col("pred").isNotNull() & ~F.isnan("pred") & (F.abs("pred") <= most)
    w = F.when(fine, (F.col("member") + 1) / members)
    rows = preds.groupBy("stream_id", "seq", "y").agg((F.sum(w * F.col("pred")) / F.sum(w)).alias("m"))
    return rows.join(fallback, ["stream_id", "seq"]).select("stream_id", "seq", "y", F.coalesce("m", "running").alias("pred"))
