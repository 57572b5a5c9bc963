"""The fold on live streams: per key, state is a pickled learner and the last number seen.

Within a micro-batch rows are taken in the order of seq; rows at or below the last number of their key
are late: dropped and counted. The kernels are those of the batch fold, so both give the same predictions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from streamtrial.operators.fold import KERNELS


def live_predictions(df: DataFrame, algo: str, params: dict | None = None, window: int = 1000) -> DataFrame:
    """stream_id, seq, y, pred, window_no, late: test then train on a streaming DataFrame (stream_id, seq, x, y)."""
    maker, task = KERNELS[algo]
    kind = "int" if task == "classification" else "double"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("seq", kind="stable")
        model, last, late = (pickle.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else (None, 0, 0)
        out = []
        for seq, x, y in zip(pdf.seq, pdf.x, pdf.y):
            if seq <= last:
                late += 1
                continue
            x = np.asarray(x)
            model = model or maker(len(x), **(params or {}))
            out.append((key[0], seq, y, model.predict(x), (seq - 1) // window, late))
            model.learn(x, y)
            last = seq
        state.update((pickle.dumps(model), int(last), int(late)))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "y", "pred", "window_no", "late"])

    return df.groupBy("stream_id").applyInPandasWithState(
        run, f"stream_id string, seq long, y {kind}, pred {kind}, window_no long, late long", "model binary, last long, late long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(predictions: DataFrame, out: str, checkpoint: str) -> None:
    """Appends all that is available to a parquet folder and stops."""
    query = predictions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
