"""Linear learners on live streams with typed state: weights as a map by class, the cursor as a value.

``live`` keeps a learner as one pickled value, which any kernel can do. Here a key's state is columns: what is kept can be
read by the state data source, a class is written when it is there and not before, and a field can be added later
without losing what is stored. The state store is RocksDB, so keys need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from streamtrial.operators.fold import KERNELS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CURSOR = "last long, rows long, late long"
WEIGHTS = "value array<double>, weight array<double>"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class TypedFold(StatefulProcessor):
    """Test then train per key; rows of a micro-batch in the order of seq, late ones dropped and counted."""

    def __init__(self, algo: str, params: dict, window: int):
        self.algo, self.params, self.window = algo, params, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", CURSOR)
        self.weights = handle.getMapState("weights", "class int", WEIGHTS)

    def _model(self, width: int):
        model, means = KERNELS[self.algo][0](width, **self.params), []
        for (c,), (value, weight) in self.weights.iterator():
            # a weight is a precision where a kernel has precisions
            known = getattr(model, "known", np.array(weight))
            means += [(c, f, v, w - known[f]) for f, (v, w) in enumerate(zip(value, weight))]
        if means:
            model.restore(means)
        return model

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last, count, late = self.cursor.get() if self.cursor.exists() else (0, 0, 0)
        model, out = None, []
        for seq, x, y in zip(pdf.seq, pdf.x, pdf.y):
            if seq <= last:
                late += 1
                continue
            x = np.asarray(x, float)
            model = model or self._model(len(x))
            out.append((key[0], int(seq), y, model.predict(x), (int(seq) - 1) // self.window, int(late)))
            model.learn(x, y)
            last, count = int(seq), count + 1
        if model is not None:
            by_class: dict[int, list] = {}
            for c, _, value, weight, _ in model.state(count):
                by_class.setdefault(int(c), []).append((value, weight))
            for c, pairs in by_class.items():
                self.weights.updateValue((c,), ([float(v) for v, _ in pairs], [float(w) for _, w in pairs]))
        self.cursor.update((int(last), int(count), int(late)))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "y", "pred", "window_no", "late"])

    def close(self) -> None:
        pass


def typed_predictions(df: DataFrame, algo: str, params: dict | None = None, window: int = 1000) -> DataFrame:
    """stream_id, seq, y, pred, window_no, late of a streaming DataFrame (stream_id, seq, x, y); for the kernels that have ``state``."""
    if not hasattr(KERNELS[algo][0], "restore"):
        raise ValueError(f"{algo!r} has no weights; live_predictions takes any learner")
    kind = "int" if KERNELS[algo][1] == "classification" else "double"
    with_rocksdb(df.sparkSession)
    schema = f"stream_id string, seq long, y {kind}, pred {kind}, window_no long, late long"
    return df.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=TypedFold(algo, params or {}, window), outputStructType=schema, outputMode="Append", timeMode="None")
