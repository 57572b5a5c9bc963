"""Helpers that the text operators share: bounded Arrow batches, hashing, cutting lineage."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text, that a Python task holds at once. A single longer text is still processed whole.
BATCH_ROWS = 512
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches to a few hundred rows, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is named, which only a local master allows, one below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: short lineage, safe when an executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are only needed while later ones are made from them: ``with Scratch(spark) as keep: ... keep(df)``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def words_column(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose texts hold about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(string_parts(batch.column(column))[2])
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of the strings; null counts as empty."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 32-bit values."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


class SubstringHash:
    """Hashes of any substrings of a symbol array, from its prefix sums: equal substrings have equal hashes."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix64(raw + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, scrambled after each; a digest for long spans. Another seed, another hash.

    Unlike sums of powers it has no pairs of spans that are sure to collide, so it may decide what is equal.
    """
    length = (end - start).astype(np.int64)
    padded = np.concatenate([np.ascontiguousarray(data), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix64(length.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D + seed * 0x1405))
    factor = np.uint64(0xD1342543DE82EF95 + 2 * seed)
    alive, step = np.flatnonzero(length <= LONG_SPAN), 0
    while len(alive := alive[length[alive] > step]):
        chunk = eight[start[alive] + step]
        over = np.maximum(0, 8 - (length[alive] - step)).astype(np.uint64) * np.uint64(8)
        chunk = (chunk << over) >> over
        out[alive] = mix64((out[alive] ^ chunk) * factor + np.uint64(step + 1))
        step += 8
    for i in np.flatnonzero(length > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8, key=b"span%d" % seed).digest(), "little")
    return out
