"""Centroid clustering by dimension-sharded Lloyd rounds, exact in whole numbers.

Vectors are cut twice: into chunks of ``CHUNK`` rows and into shards of ``COLUMNS`` columns. A round is

1. each (chunk, shard) computes its part of all squared distances, against its slice of the centroids only;
2. the parts of a chunk are added, and the least sum (the smaller number of equals) is each row's cluster;
3. each (chunk, shard) sums its columns per cluster; the sums of a shard give the new slice of the centroids.

What crosses the network in a round is the parts of the distances, the clusters, and the shards once; what reaches the
driver is the centroids themselves (their number times the dimensions) and never anything of a row. Chunks
come from the order of the rows in their files, so equal vectors, however many, fall into chunks like others.

Defined cases: a vector with another number of components, or with one that is null or not finite, has no row; components
are multiplied by 64 and rounded down, and held within 2**27 on either side, where sums still are exact; rows
with the same id are vectors of their own, and start centroids in the order of their components; rows without id are
clustered but don't start centroids; with fewer vectors than centroids wanted all of them start one; very long tables
differ in the number of chunks only; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.llm.common import Scratch, bounded, written

CHUNK, COLUMNS = 4096, 32
BOUND = 1 << 27
RESULT = "vec_id long, cluster int, distance long"


def whole_vectors(df: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """vec_id, x array<long> of the vectors that are kept."""
    x = F.col(column)
    fine = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.floor(F.greatest(F.least(v.cast("double") * 64, F.lit(float(BOUND))), F.lit(float(-BOUND))))
    return df.where(x.isNotNull()).where(fine).select(F.col("vec_id").cast("long"), F.transform(x, held).alias("x"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k least hashes of ``seed:vec_id``, in their order."""
    named = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return np.array([r.x for r in named.orderBy("h", "x").limit(k).collect()], np.int64)


def _least(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest signed type."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, none negative, as planes of their bytes, without planes of zeros above."""
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, count)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def shards(vectors: DataFrame, dims: int) -> DataFrame:
    """chunk, shard, rows, kind (of number), data, and the ids in shard 0."""
    def cut(ids: list[pa.Array], parts: list[np.ndarray], nth: int) -> pa.RecordBatch:
        x, chunk = np.concatenate(parts), TaskContext.get().partitionId() << 32 | nth
        slices = [_least(x[:, a : a + COLUMNS]) for a in range(0, dims, COLUMNS)]
        named = pa.array([pa.concat_arrays(ids).to_pylist(), *[None] * (len(slices) - 1)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(slices)), pa.array(range(len(slices)), pa.int32()), pa.array([len(x)] * len(slices), pa.int32()), pa.array([s.dtype.str for s in slices]), pa.array([s.tobytes() for s in slices]), named],
            names=["chunk", "shard", "rows", "kind", "data", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, nth = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy().reshape(-1, dims))
                held += part.num_rows
                if held >= CHUNK:
                    yield cut(ids, parts, nth)
                    ids, parts, held, nth = [], [], 0, nth + 1
        if held:
            yield cut(ids, parts, nth)

    return vectors.mapInArrow(run, "chunk long, shard int, rows int, kind string, data binary, ids array<long>")


def _slice(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(batch.column("data")[i].as_py(), batch.column("kind")[i].as_py()).reshape(batch.column("rows")[i].as_py(), -1)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and centroids."""
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * top * top * x.shape[1] < 1 << 53:  # products in doubles are whole and exact
        inner = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        inner = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * inner + (c * c).sum(1)


def parts_of_distances(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """chunk, rows, part (packed distances of the shard's columns), ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("shard")[i].as_py() * COLUMNS
                part = packed(squared(_slice(batch, i), centroids[:, at : at + COLUMNS]).ravel())
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("chunk"), one.column("rows"), pa.array([part]), one.column("ids")], names=["chunk", "rows", "part", "ids"])

    return table.mapInArrow(run, "chunk long, rows int, part binary, ids array<long>")


def _added(table: pa.Table, k: int) -> np.ndarray:
    rows = table.column("rows")[0].as_py()
    return sum(unpacked(p.as_py(), rows * k) for p in table.column("part")).reshape(rows, k)


def assigned(parts: DataFrame, k: int) -> DataFrame:
    """chunk, clusters (two bytes a row): parts of a chunk added, then the least."""
    def run(table: pa.Table) -> pa.Table:
        nearest = _added(table, k).argmin(1).astype("<u2").tobytes()
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "clusters": pa.array([nearest])})

    return parts.drop("ids").groupBy("chunk").applyInArrow(run, "chunk long, clusters binary")


def assigned_rows(parts: DataFrame, k: int) -> DataFrame:
    """vec_id, cluster, distance of every row."""
    def run(table: pa.Table) -> pa.Table:
        total = _added(table, k)
        ids = next(v for v in table.column("ids") if v.is_valid).values
        nearest = total.argmin(1)
        return pa.table({"vec_id": ids, "cluster": pa.array(nearest.astype(np.int32)), "distance": pa.array(total[np.arange(len(total)), nearest])})

    return parts.groupBy("chunk").applyInArrow(run, RESULT)


def sums(table: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """shard, cluster, n, s<column>: sums of each shard's columns over the rows of each cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x, own = _slice(batch, i).astype(np.int64), np.frombuffer(batch.column("clusters")[i].as_py(), "<u2")
                total = totals.setdefault(batch.column("shard")[i].as_py(), np.zeros((k, COLUMNS + 1), np.int64))
                order = np.argsort(own, kind="stable")
                names, first = np.unique(own[order], return_index=True)
                total[names, 0] += np.diff(np.append(first, len(own)))
                total[names, 1 : 1 + x.shape[1]] += np.add.reduceat(x[order], first, axis=0)
        for shard, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array(range(k), pa.int32()), *[pa.array(c) for c in total.T]], names=["shard", "cluster", *columns])

    columns = ["n", *[f"s{i}" for i in range(COLUMNS)]]
    rows = table.select("chunk", "shard", "rows", "kind", "data").join(clusters, "chunk")
    found = rows.mapInArrow(run, "shard int, cluster int, " + ", ".join(f"{c} long" for c in columns))
    return found.groupBy("shard", "cluster").agg(*[F.sum(c).alias(c) for c in columns])


def moved(totals: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each shard's slice of the centroids by its sums, rounded down; empty clusters stay."""
    mean = lambda c: F.expr(f"({c} - pmod({c}, n)) div n")
    out = centroids.copy()
    for r in totals.where("n > 0").select("shard", "cluster", F.array(*[mean(f"s{i}") for i in range(COLUMNS)]).alias("mean")).collect():  # as many numbers as the centroids have
        at = r.shard * COLUMNS
        out[r.cluster, at : at + COLUMNS] = r["mean"][: out.shape[1] - at]
    return out


def lloyd(df: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that is kept, stored; and the centroids."""
    spark = bounded(df.sparkSession)
    vectors = whole_vectors(df, dims, column)
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT), centroids.reshape(0, dims)
    with Scratch(spark) as keep:
        table = keep(shards(vectors, dims))
        for _ in range(rounds):
            clusters = keep(assigned(parts_of_distances(table, centroids), len(centroids)))
            centroids = moved(sums(table, clusters, len(centroids)), centroids)
        return written(assigned_rows(parts_of_distances(table, centroids), len(centroids))), centroids


def digest(df: DataFrame, **options) -> DataFrame:
    """The rows of ``lloyd`` with the inertia of their cluster and of all, and a hash of their centroid."""
    rows, centroids = lloyd(df, **options)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    shas = rows.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    told = shas.join(per, "cluster").join(F.broadcast(total))  # a row per centroid, and one
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
