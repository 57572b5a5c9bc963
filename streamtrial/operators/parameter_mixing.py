"""Order-dependent linear learners over one huge stream, by iterative parameter mixing.

A fold needs all rows of a key in one task. Here a stream is cut by ``seq`` into shards of ``shard_rows`` rows, and
``shards`` of them that follow each other are a round: each is folded, test then train, from the weights that the
round starts with; the weights of its shards are then averaged by class and feature in Spark and start the next
round (McDonald, Hall and Mann 2010). So a row is predicted by the rounds before it and by the rows of its own
shard before it. With one shard a round this is the fold itself; with more it is an approximation, and
its result depends on ``shards`` and ``shard_rows``, but not on how many machines there are.

Rounds follow each other by nature, and a job costs more than a small round. So the stream is cut once into spans of whole
rounds, of at most ``SPAN_ROWS`` rows unless one round is longer. A span of one round is a job with a task per shard; a span of more is a
job with one task, which works through the rounds with many shards side by side (``lockstep``) and few one after the other in plain
numbers. A job reads its own span only.
No task holds more than one span. What reaches the driver is one set of weights a span.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.operators.fold import KERNELS, matrix, run_rows
from streamtrial.operators.lockstep import LOCKSTEP, run_streams
from streamtrial.operators.plain import PLAIN, made
from streamtrial.plans.storage import shared_dir

STATE = "array<struct<class:int,feature:int,value:double,weight:double,gained:double>>"
FIELDS = ("class", "feature", "value", "weight", "gained")
#: Rows of a job that takes several rounds: a minute of work at most, and less memory than a task has.
SPAN_ROWS = 1_000_000
#: Up to so many shards are folded one after the other in plain numbers, which costs less than steps of numpy over few of them.
SIDE_BY_SIDE = 16


def one_round(block: DataFrame, algo: str, params: dict, start: list[tuple] | None, shards: int, shard_rows: int) -> DataFrame:
    """stream_id, seq, y, pred of the block's rows; the last row of a shard has its ``state``."""
    maker, task = KERNELS[algo]
    kind = "int" if task == "classification" else "double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rows, last = None, 0, None
        for pdf in frames:
            if not len(pdf):
                continue
            if last is not None:
                yield last  # a batch goes out when it isn't the last
            x, y = np.stack(pdf.x.to_numpy()), pdf.y.to_numpy()
            if model is None:
                model = maker(x.shape[1], **params)
                if start is not None:
                    model.restore(start)
            last = pdf[["stream_id", "seq", "y"]].assign(pred=run_rows(model, x, y), state=None)
            rows += len(pdf)
        if last is not None:
            last = last.reset_index(drop=True)
            last.at[len(last) - 1, "state"] = [dict(zip(FIELDS, s)) for s in model.state(rows, start)]
            yield last

    shard = F.pmod(F.floor((F.col("seq") - 1) / shard_rows), F.lit(shards)).cast("int")
    dealt = block.select("stream_id", "seq", "x", "y").repartitionById(shards, shard).sortWithinPartitions("seq")
    return dealt.mapInPandas(run, f"stream_id string, seq long, y {kind}, pred {kind}, state {STATE}")


def shard_states(algo: str, params: dict, start: list[tuple] | None, x: np.ndarray, y: np.ndarray, shard_rows: int, labels: np.ndarray) -> tuple[list, list[list[tuple]]]:
    """Predictions of a round's rows, and the state of each of its shards."""
    lengths = np.diff([*range(0, len(x), shard_rows), len(x)])
    if len(lengths) > SIDE_BY_SIDE and KERNELS[algo][0] in LOCKSTEP:
        model = LOCKSTEP[KERNELS[algo][0]](len(lengths), x.shape[1], labels, **params)
        if start is not None:
            model.restore(start)
        return run_streams(model, x, y, lengths).tolist(), model.state(lengths)
    pred, states = [], []
    for at, n in zip(range(0, len(x), shard_rows), lengths):
        model = made(KERNELS[algo][0], x.shape[1], params) if KERNELS[algo][0] in PLAIN else KERNELS[algo][0](x.shape[1], **params)
        if start is not None:
            model.restore(start)
        pred += run_rows(model, x[at : at + n], y[at : at + n])
        states.append(model.state(int(n), start))
    return pred, states


def mean_state(states: list[list[tuple]], start: list[tuple] | None) -> list[tuple]:
    """(class, feature, value, gained): the mean of the shards' values by their weights, and the sum of what they and the rounds before gained."""
    sums: dict[tuple[int, int], list[float]] = {(int(c), f): [0.0, 0.0, gained] for c, f, _, gained in start or ()}
    for c, f, value, weight, gained in (row for state in states for row in state):
        own = sums.setdefault((int(c), f), [0.0, 0.0, 0.0])
        own[0] += value * weight
        own[1] += weight
        own[2] += gained
    return [(c, f, v / w, gained) for (c, f), (v, w, gained) in sorted(sums.items())]


def many_rounds(span: DataFrame, algo: str, params: dict, start: list[tuple] | None, shards: int, shard_rows: int) -> DataFrame:
    """stream_id, seq, y, pred of a span's rows; the last row has the ``state`` that the next span starts with, as if of one shard."""
    kind = "int" if KERNELS[algo][1] == "classification" else "double"

    number = pa.int32() if kind == "int" else pa.float64()
    states = pa.list_(pa.struct(list(zip(FIELDS, (pa.int32(), pa.int32(), *[pa.float64()] * 3)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        x, y, means, pred = matrix(rows), rows["y"].to_numpy(), start, []
        rows = rows.drop_columns("x")
        labels = np.unique(np.append(y, [c for c, *_ in means or ()]).astype(y.dtype)) if kind == "int" else y
        for at in range(0, len(x), shards * shard_rows):
            own = slice(at, at + shards * shard_rows)
            more, ends = shard_states(algo, params, means, x[own], y[own], shard_rows, labels)
            pred += more
            means = mean_state(ends, means)
        last = [dict(zip(FIELDS, (c, f, v, 1.0, gained))) for c, f, v, gained in means]
        state = pa.chunked_array([pa.nulls(len(rows) - 1, states), pa.array([last], states)])
        out = rows.append_column("pred", pa.array(pred, number)).append_column("state", state)
        yield from out.to_batches(max_chunksize=10_000)

    rows = span.select("stream_id", "seq", "y", "x").coalesce(1).sortWithinPartitions("seq")
    return rows.mapInArrow(run, f"stream_id string, seq long, y {kind}, pred {kind}, state {STATE}")


def mixed(df: DataFrame, algo: str, params: dict | None = None, shards: int = 16, shard_rows: int = 5000) -> DataFrame:
    """stream_id, seq, y, pred of a linear learner on the one stream of ``df``, which should be a stored table; ``seq`` counts from 1."""
    if shards < 1 or shard_rows < 1:
        raise ValueError("shards and shard_rows must be at least 1")
    spark, kind = df.sparkSession, "int" if KERNELS[algo][1] == "classification" else "double"
    n = df.agg(F.max("seq")).first()[0] or 0
    if not n:
        return df.select("stream_id", "seq", "y", F.lit(None).cast(kind).alias("pred")).where("false")
    rounds = max(1, SPAN_ROWS // (shards * shard_rows))
    size, top = rounds * shards * shard_rows, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spans = df.select("stream_id", "seq", "x", "y").withColumn("span", F.floor((F.col("seq") - 1) / size))
    spans.repartition("span").sortWithinPartitions("span", "seq").write.partitionBy("span").parquet(f"{top}/in")
    schema, start = df.select("stream_id", "seq", "x", "y").schema, None
    for at in range((n - 1) // size + 1):
        span, path = spark.read.schema(schema).parquet(f"{top}/in/span={at}"), f"{top}/out/span={at}"
        job = many_rounds if rounds > 1 else one_round
        rows = job(span, algo, params or {}, start, shards, shard_rows)
        rows.write.parquet(path)
        told = spark.read.schema(rows.schema).parquet(path).where("state is not null").orderBy("seq").select("state").collect()  # classes x features of each shard
        states = [[tuple(s) for s in r.state] for r in told]
        if rounds > 1:  # what the rounds gained so far is in it
            start = [(c, f, value, gained) for c, f, value, _, gained in states[0]]
        else:
            start = mean_state(states, start)
    kept = f"stream_id string, seq long, y {kind}, pred {kind}"
    return spark.read.schema(kept).parquet(*[f"{top}/out/span={at}" for at in range((n - 1) // size + 1)])
