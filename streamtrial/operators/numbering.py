"""Dense numbering of a table in an order, without a window over all rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
#: Bounds that are told apart by nested conditions; more go through arrays of so many each.
HALVED = 64


def place(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most ``value``, by halving: a few comparisons a row."""
    if not bounds:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(value < F.lit(bounds[at]), search(low, at)).otherwise(search(at + 1, high))

    if len(bounds) <= HALVED:
        return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))
    # larger ones: the block of bounds by an array of every HALVED-th, then the place in its block
    heads = F.array(*[F.lit(b) for b in bounds[::HALVED]])
    blocks = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + HALVED]]) for i in range(0, len(bounds), HALVED)])
    block = F.size(F.filter(heads, lambda b: b <= value)) - 1  # -1 for null too
    inside = F.size(F.filter(F.get(blocks, F.greatest(block, F.lit(0))), lambda b: b <= value))
    return F.when(block < 0, F.lit(0)).otherwise(block * HALVED + inside)


def numbered(df: DataFrame, order: list[str], key: str | None = None) -> DataFrame:
    """Adds ``seq`` (from 1, in ``order``) and ``n`` (number of rows), per ``key`` if one is given.

    Without a key rows are dealt to ranges of the first order column, between quantiles of it; a row's number
    is its number inside its range plus the rows in the ranges before (a few thousand counts). The ranges
    are a function of the row alone, so a task that runs again numbers alike.
    """
    if key:
        rows = Window.partitionBy(key)
        return df.withColumn("seq", F.row_number().over(rows.orderBy(*order)).cast("long")).withColumn("n", F.count("*").over(rows))
    lead = F.col(order[0])
    cuts = min(RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(lead, [i / cuts for i in range(cuts)], 20 * cuts).alias("q")).first().q
    dealt = df.withColumn("_range", place(lead, sorted(set(found or [0]))))
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    places = sorted(sizes)
    before = dict(zip(places, accumulate([0, *[sizes[p] for p in places]])))
    starts = df.sparkSession.createDataFrame([(p, int(before[p])) for p in places] or [(-1, 0)], "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("_nth", inside).join(F.broadcast(starts), "_range")  # at most RANGES rows
    return out.withColumn("seq", F.col("_nth") + F.col("_before")).withColumn("n", F.lit(sum(sizes.values())).cast("long")).drop("_range", "_nth", "_before")
