"""Running aggregates over the order of a stream, in blocks.

A block's totals, the totals of the blocks before it, and a window inside the block give each row the
aggregate of all rows before it (exclusive) or up to it (inclusive). With blocks of about the root of the
number of rows neither the window inside a block nor the one over the blocks grows beyond that root.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BLOCK = 1000
_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}


def scan(df: DataFrame, measures: dict[str, tuple[str, Column]], inclusive: bool = False, block: int | None = None) -> DataFrame:
    """Adds a column per measure, ``(sum | min | max, value)``, running over seq within stream_id.

    Sums start at 0, minima and maxima at null. ``df`` is read twice, so it should be a stored or cheap plan.
    """
    if block is None:
        block = max(LEAST_BLOCK, isqrt(df.agg(F.max("seq").alias("m")).first().m or 1))
    names = list(measures)
    # dealt and sorted as they are, before the measures make them wide; totals and windows share the exchange
    rows = df.withColumn("_blk", F.floor((F.col("seq") - 1) / block)).repartition("stream_id", "_blk").sortWithinPartitions("stream_id", "_blk", "seq")
    rows = rows.withColumns({f"_v_{k}": v for k, (_, v) in measures.items()})
    totals = rows.groupBy("stream_id", "_blk").agg(*[_FUNCTIONS[measures[k][0]](f"_v_{k}").alias(f"_t_{k}") for k in names])
    earlier = Window.partitionBy("stream_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("stream_id", "_blk", *[_FUNCTIONS[measures[k][0]](f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in names])
    inside = Window.partitionBy("stream_id", "_blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({f"_i_{k}": _FUNCTIONS[measures[k][0]](f"_v_{k}").over(inside) for k in names}).join(before, ["stream_id", "_blk"])

    def joined(k: str) -> Column:
        a, b = F.col(f"_b_{k}"), F.col(f"_i_{k}")
        return {"sum": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least(a, b), "max": F.greatest(a, b)}[measures[k][0]]

    return rows.select(*df.columns, *[joined(k).alias(k) for k in names])
