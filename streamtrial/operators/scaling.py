"""Running scalers, selectors and target normalisation as scans: views of x before and after each row is learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtrial.operators.scan import scan


def _flat(df: DataFrame, width: int, *more: Column) -> DataFrame:
    return df.select("stream_id", "seq", "y", *[F.col("x")[f].alias(f"f{f}") for f in range(width)], *more)


def _safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def scaled(df: DataFrame, width: int, kind: str, inclusive: bool = True, with_std: bool = True, weight: Column | None = None) -> DataFrame:
    """stream_id, seq, y and scaled g<f>, by the rows up to (inclusive) or before each row.

    ``weight``: how often a row is learned, as in online bagging; a row of weight 0 leaves the statistics alone.

    ``minmax``: 0 without a range; ``online``: range of the rows so far, 1 if it is zero; ``standard``: population
    deviation, 0 without one; ``maxabs``. Before any row the value is 0.
    """
    rows, fs = _flat(df, width, (F.lit(1) if weight is None else weight).alias("_w")), [f"f{f}" for f in range(width)]
    w, seen = F.col("_w"), lambda v: F.when(F.col("_w") > 0, v)
    if kind in ("minmax", "online"):
        ran = scan(rows, {f"{e}_{f}": (e, seen(F.col(f))) for f in fs for e in ("min", "max")}, inclusive)
        out = [_safe(F.col(f) - F.col(f"min_{f}"), F.col(f"max_{f}") - F.col(f"min_{f}")) for f in fs]
    elif kind == "maxabs":
        ran = scan(rows, {f"max_{f}": ("max", seen(F.abs(f))) for f in fs}, inclusive)
        out = [_safe(F.col(f), F.col(f"max_{f}")) for f in fs]
    else:
        ran = scan(rows, {"n": ("sum", w), **{f"s_{f}": ("sum", w * F.col(f)) for f in fs}, **{f"q_{f}": ("sum", w * F.col(f) * F.col(f)) for f in fs}}, inclusive)
        n = F.when(F.col("n") > 0, F.col("n"))
        out = []
        for f in fs:
            mean = F.col(f"s_{f}") / n
            var = F.col(f"q_{f}") / n - mean * mean
            std = F.when(var > 1e-12 * F.col(f"q_{f}") / n, F.sqrt(var))
            centred = F.coalesce(F.col(f) - mean, F.lit(0.0))
            out.append(F.coalesce(centred / std, F.lit(0.0)) if with_std else centred)
    return ran.select("stream_id", "seq", "y", *[F.coalesce(c, F.lit(0.0)).alias(f"g{i}") for i, c in enumerate(out)])


def target_normalised(df: DataFrame, inclusive: bool = True) -> DataFrame:
    """stream_id, seq, y, mean, std, z of the target; population deviation, 1 below two rows, z = 0 if it is 0."""
    ran = scan(df.select("stream_id", "seq", "y"), {"n": ("sum", F.lit(1)), "s": ("sum", F.col("y")), "q": ("sum", F.col("y") * F.col("y"))}, inclusive)
    mean = F.coalesce(F.col("s") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))
    var = F.greatest(F.col("q") / F.when(F.col("n") > 0, F.col("n")) - mean * mean, F.lit(0.0))
    std = F.when(F.col("n") < 2, 1.0).otherwise(F.sqrt(var))
    return ran.select("stream_id", "seq", "y", mean.alias("mean"), std.alias("std"), _safe(F.col("y") - mean, std).alias("z"))


def variance_kept(df: DataFrame, width: int, threshold: float = 0.0, least: int = 1) -> DataFrame:
    """stream_id, seq and k<f>: whether feature f stays, by its variance over the rows before (all stay below ``least`` rows)."""
    rows, fs = _flat(df, width), [f"f{f}" for f in range(width)]
    ran = scan(rows, {"n": ("sum", F.lit(1)), **{f"s_{f}": ("sum", F.col(f)) for f in fs}, **{f"q_{f}": ("sum", F.col(f) * F.col(f)) for f in fs}})
    keep = lambda f: (F.col("n") < least) | (F.col(f"q_{f}") * F.col("n") - F.col(f"s_{f}") * F.col(f"s_{f}") > threshold * F.col("n") * F.col("n"))
    return ran.select("stream_id", "seq", *[keep(f).alias(f"k{i}") for i, f in enumerate(fs)])


def k_best(df: DataFrame, width: int, k: int) -> DataFrame:
    """stream_id, seq, best: the k features (in their order) with the greatest absolute correlation with y in the rows before."""
    rows, fs = _flat(df, width), [f"f{f}" for f in range(width)]
    y = F.col("y").cast("double")
    sums = {"n": ("sum", F.lit(1)), "sy": ("sum", y), "qy": ("sum", y * y)}
    for f in fs:
        sums |= {f"s_{f}": ("sum", F.col(f)), f"q_{f}": ("sum", F.col(f) * F.col(f)), f"c_{f}": ("sum", F.col(f) * y)}
    ran = scan(rows, sums)

    def strength(f: str) -> Column:
        n = F.col("n")
        c = n * F.col(f"c_{f}") - F.col(f"s_{f}") * F.col("sy")
        v = (n * F.col(f"q_{f}") - F.col(f"s_{f}") * F.col(f"s_{f}")) * (n * F.col("qy") - F.col("sy") * F.col("sy"))
        return F.round(F.when(v > 1e-9, F.abs(c) / F.sqrt(v)).otherwise(0.0), 6)

    ranked = F.array_sort(F.array(*[F.struct((-strength(f)).alias("s"), F.lit(i).alias("f")) for i, f in enumerate(fs)]))
    return ran.select("stream_id", "seq", F.sort_array(F.transform(F.slice(ranked, 1, k), lambda e: e["f"])).alias("best"))
