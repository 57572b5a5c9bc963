"""Drift detectors as kernels over one value per row, and the fold that runs them per stream."""

from __future__ import annotations

from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.operators.scan import scan
from streamtrial.plans.storage import stored


class Adwin:
    """Adaptive windowing (Bifet and Gavalda 2007): an exponential histogram of the values since the last cut.

    Every ``clock`` rows all cuts between buckets are tested; while the means of two parts differ by more
    than the bound for the confidence, the oldest bucket is dropped.
    """

    def __init__(self, delta: float = 0.002, clock: int = 32, per_level: int = 5):
        self.delta, self.clock, self.per_level, self.rows = delta, clock, per_level, 0
        self.levels: list[list[tuple[float, float]]] = [[]]  # level i: (sum, squared deviations) of 2**i rows, oldest first
        self.new: list[tuple[float, float]] = []  # rows since the last test

    @property
    def width(self) -> int:
        self._settled()
        return sum(len(b) << i for i, b in enumerate(self.levels))

    @property
    def mean(self) -> float:
        n = self.width
        return sum(s for b in self.levels for s, _ in b) / n if n else 0.0

    def update(self, value: float) -> bool:
        self.rows += 1
        self.new.append((value, 0.0))
        return self.rows % self.clock == 0 and self._cut()

    def _settled(self) -> None:
        """New rows go to the lowest level; of each level the oldest pairs go up until few enough are left, as one by one."""
        if not self.new:
            return
        self.levels[0] += self.new
        self.new = []
        for i, level in enumerate(self.levels):
            if len(level) <= self.per_level:
                break
            if i + 1 == len(self.levels):
                self.levels.append([])
            at, n, up = 0, 1 << i, self.levels[i + 1]
            while len(level) - at > self.per_level:
                (s1, v1), (s2, v2) = level[at], level[at + 1]
                up.append((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * n)))
                at += 2
            del level[:at]

    def _cut(self) -> bool:
        found = False
        while (n := self.width) > 10 and self._differs(n):
            found = True
            while not self.levels[-1]:
                self.levels.pop()
            self.levels[-1].pop(0)
        return found

    def _differs(self, n: int) -> bool:
        buckets = [(1 << i, s, v) for i in range(len(self.levels) - 1, -1, -1) for s, v in self.levels[i]]
        total = sum([b[1] for b in buckets])
        mean = total / n
        var = sum([v + m * (s / m - mean) ** 2 for m, s, v in buckets]) / n
        d = log(2 * log(n) / self.delta)
        c = 2 / 3 * d
        n0, s0, end = 0, 0.0, n - 5
        for m, s, _ in buckets:
            n0 += m
            s0 += s
            if n0 < 5:
                continue
            if n0 > end:
                break
            n1 = n - n0
            h = 1 / n0 + 1 / n1
            gap = s0 / n0 - (total - s0) / n1
            if (gap if gap >= 0 else -gap) > sqrt(2 * h * var * d) + c * h:
                return True
        return False


class Eddm:
    """Early drift detection (Baena-Garcia et al. 2006) on 0/1 errors: distances between errors shrink.

    With mean m and deviation s of the distances, drift is told when (m + 2 s) falls below ``drift`` of its
    greatest value so far, after ``least`` errors; then all starts anew.
    """

    def __init__(self, drift: float = 0.9, least: int = 30):
        self.drift, self.least = drift, least
        self._reset()

    def _reset(self) -> None:
        self.rows, self.last, self.n, self.mean, self.m2, self.top = 0, 0, 0, 0.0, 0.0, 0.0

    def update(self, error: float) -> bool:
        self.rows += 1
        if not error:
            return False
        gap, self.last = self.rows - self.last, self.rows
        self.n += 1
        d = gap - self.mean
        self.mean += d / self.n
        self.m2 += d * (gap - self.mean)
        if self.n < self.least:
            return False
        level = self.mean + 2 * sqrt(self.m2 / self.n)
        self.top = max(self.top, level)
        if level < self.drift * self.top:
            self._reset()
            return True
        return False


DETECTORS = {"adwin": Adwin, "eddm": Eddm}


def detect(df: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """stream_id, seq of the rows at which drift is told; ``df``: stream_id, seq, value."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        detector = DETECTORS[name](**(params or {}))
        return pdf[[detector.update(v) for v in pdf.value]][["stream_id", "seq"]]

    return df.select("stream_id", "seq", F.col("value").cast("double")).groupBy("stream_id").applyInPandas(run, "stream_id string, seq long")


def first_eddm(df: DataFrame, ratio: float = 0.9, least: int = 30) -> DataFrame:
    """stream_id, seq of the first drift only, in windows over the error rows: no order-dependent task."""
    own = Window.partitionBy("stream_id").orderBy("seq")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    gaps = df.where("value = 1").select("stream_id", "seq", (F.col("seq") - F.coalesce(F.lag("seq").over(own), F.lit(0))).alias("gap"))
    level = F.avg("gap").over(upto) + 2 * F.stddev_pop("gap").over(upto)
    rows = gaps.select("stream_id", "seq", level.alias("level"), F.row_number().over(own).alias("n")).where(F.col("n") >= least)
    rows = rows.withColumn("top", F.max("level").over(upto))
    return rows.where(F.col("level") < ratio * F.col("top")).groupBy("stream_id").agg(F.min("seq").alias("seq"))


def _epoch_eddm(errors: DataFrame, start: int, ratio: float, least: int) -> int | None:
    """The first drift among the error rows (stream_id, seq) of one stream after ``start``, by running sums in blocks."""
    ran = scan(errors, {"before": ("max", F.col("seq"))})
    gaps = stored(ran.select("stream_id", "seq", (F.col("seq") - F.coalesce("before", F.lit(start))).cast("double").alias("gap")))
    sums = scan(gaps, {"k": ("sum", F.lit(1)), "s": ("sum", F.col("gap")), "q": ("sum", F.col("gap") * F.col("gap"))}, inclusive=True)
    mean = F.col("s") / F.col("k")
    level = mean + 2 * F.sqrt(F.greatest(F.col("q") / F.col("k") - mean * mean, F.lit(0.0)))
    rows = stored(sums.where(F.col("k") >= least).select("stream_id", "seq", level.alias("level")))
    tops = scan(rows, {"top": ("max", F.col("level"))}, inclusive=True)
    return tops.where(F.col("level") < ratio * F.col("top")).agg(F.min("seq")).first()[0]


def every_eddm(df: DataFrame, ratio: float = 0.9, least: int = 30, look: int = 100_000) -> DataFrame:
    """stream_id, seq of every drift of the one stream of ``df`` (stream_id, seq, value), which should be a stored table.

    The detector starts anew behind each drift, so epochs come one after the other; inside an epoch all is running sums, and no task
    holds the stream. An epoch is looked for in the next ``look`` rows, then in twice as many, until it is found or the
    rows end: all rows are read a few times, however many epochs there are.
    """
    end = df.agg(F.max("seq")).first()[0] or 0
    name = df.select("stream_id").first()
    found, at, ahead = [], 0, look
    while at < end:
        errors = df.where(F.col("seq").between(at + 1, at + ahead) & (F.col("value") == 1)).select("stream_id", "seq")
        cut = _epoch_eddm(errors, at, ratio, least)
        if cut is not None:
            found.append((name[0], cut))
            at, ahead = cut, look
        elif at + ahead >= end:
            break
        else:
            ahead *= 2
    return df.sparkSession.createDataFrame(found, "stream_id string, seq long")


def score_drops(windows: DataFrame, ratio: float = 0.95) -> DataFrame:
    """The windows (stream_id, window_no, score) whose score is below ``ratio`` of the one before."""
    before = F.lag("score").over(Window.partitionBy("stream_id").orderBy("window_no"))
    return windows.withColumn("before", before).where(F.col("score") < ratio * F.col("before")).select("stream_id", "window_no", "score", "before")
