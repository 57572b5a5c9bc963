"""Weighted count, mean and squared deviations as an aggregate that merges, and as a running one.

Sums are taken of deviations from a shift near the mean, so nothing cancels; Spark adds them up before the shuffle, and two
states are one by Chan's formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtrial.operators.scan import scan


def state(value: Column, weight: Column, shift: float = 0.0) -> Column:
    """The aggregate (n, mean, m2) of a group, as a struct; nulls and rows of weight 0 take no part. n = 0 has mean null."""
    w = F.when(value.isNotNull() & (weight > 0), weight).cast("double")
    n, s, q = F.sum(w), F.sum(w * (value - shift)), F.sum(w * (value - shift) * (value - shift))
    return F.struct(F.coalesce(n, F.lit(0.0)).alias("n"), (s / n + shift).alias("mean"), F.coalesce(F.greatest(q - s * s / n, F.lit(0.0)), F.lit(0.0)).alias("m2"))


def merged(a: Column, b: Column) -> Column:
    """The state of both states' rows together."""
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))
    return F.when(b.isNull() | (b["n"] == 0), a).when(a.isNull() | (a["n"] == 0), b).otherwise(both)


def total(of: Column, shift: float = 0.0) -> Column:
    """The aggregate state of all states of a group: sums that Spark combines before the shuffle, not a list."""
    n, d = of["n"], of["mean"] - shift
    weight, s = F.sum(n), F.sum(n * d)
    return F.struct(weight.alias("n"), (s / weight + shift).alias("mean"), F.greatest(F.sum(of["m2"] + F.coalesce(n * d * d, F.lit(0.0))) - s * s / weight, F.lit(0.0)).alias("m2"))


def variance(of: Column) -> Column:
    """Sample variance, with the sum of weights less one below; 0 up to a weight of one."""
    return F.when(of["n"] > 1, of["m2"] / (of["n"] - 1)).otherwise(0.0)


def running(df: DataFrame, value: str, weight: str, shift: float = 0.0) -> DataFrame:
    """stream_id, seq, n, mean, var of the rows up to each one."""
    w, d = F.col(weight).cast("double"), F.col(value) - shift
    ran = scan(df.select("stream_id", "seq", value, weight), {"n": ("sum", w), "s": ("sum", w * d), "q": ("sum", w * d * d)}, inclusive=True)
    n = F.when(F.col("n") > 0, F.col("n"))
    var = F.when(F.col("n") > 1, F.greatest(F.col("q") - F.col("s") * F.col("s") / n, F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
    return ran.select("stream_id", "seq", "n", (F.col("s") / n + shift).alias("mean"), var.alias("var"))
