"""Naive Bayes over blocks: the same from any number of them, without a window of Spark for each sum."""

import numpy as np
import pytest

from streamtrial.operators import naive_bayes as nb

SCHEMA = "stream_id string, seq long, x array<double>, y int"


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(4)
    rows = [(name, i + 1, [None if rng.random() < 0.05 else float(v) for v in np.round(rng.normal(i % 3, 1, 2), 1)], i % 3) for name, n in (("a", 400), ("b", 31), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_blocks_and_chunks_change_nothing(stream, monkeypatch):
    def said():
        return sorted((r.stream_id, r.seq, r.y, r.pred, *[round(r[f"p{c}"], 9) for c in range(3)]) for r in nb.naive_bayes(stream, (0, 1, 2), 2, proba=True).collect())

    want = said()
    assert len(want) == 432 and {r[3] for r in want} == {-1, 0, 1, 2}
    monkeypatch.setattr(nb, "LEAST_BLOCK", 7)  # blocks of 20 rows
    monkeypatch.setattr(nb, "CHUNK_ROWS", 40)
    assert said() == want


def test_windows_hold_a_row_per_block_only(stream, monkeypatch):
    monkeypatch.setattr(nb, "LEAST_BLOCK", 7)
    plan = nb.naive_bayes(stream, (0, 1, 2), 2)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "_blk" in windows[0] and "seq" not in windows[0]
