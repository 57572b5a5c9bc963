"""Linking inside buckets without listing all pairs: stars, components, and an exact pass over the rest.

Two rows may be linked only if they share a bucket. A bucket of n members needs n (n - 1) / 2 tests if
nothing else is known, but most are void for connected components, and most others can be told from
sketches of a few hundred bytes that bound a pair's distance from below:

1. star: each member is tested against the bucket's least member only, and of its several such pivots
   against the least first, against others only if they are in other components afterwards;
2. components of the links so far; buckets whose members lie in one component are done;
3. in the other buckets the sketches of pairs of different components are compared, as matrices in blocks
   of ``CHUNK`` members. Three times pairs are given out, tested and the components joined: of each component the
   closest pair to any other (no more pairs than components), then of each two components the closest, then
   every pair that its sketches don't exclude.

No link is lost, whatever the buckets look like. Pairs are emitted only if their sketches allow a link and
they are in different components. Step 3 compares sketches in a number that grows with the members outside a
bucket's largest component times its members, spread over blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import Scratch, written

#: Sides of at most so many bytes (checked, not guessed) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Edge tables of at most so many rows (checked) are worked on in one task, larger ones by shuffles.
ONE_TASK_EDGES = 200_000
#: Members of a block; a bucket of more is cut into chunks, and each two chunks are a block.
CHUNK = 8192


def sized(df: DataFrame, row_bytes: Column | None = None, most: int | None = None) -> DataFrame:
    """A stored table, marked for broadcast if its rows are few enough; ``row_bytes``: of a row, by default 8 a column."""
    total = df.agg(F.sum(F.lit(8 * len(df.columns)) if row_bytes is None else row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if most is None else most) else df


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """id, component (its least id) of all ids of the edges (a, b), by alternating large and small stars.

    Each round is two aggregations and joins; a hub's edges are summed up before the shuffle and the join
    has one row per node on its other side, so Spark can split it. Up to ``one_task`` edges are kept together.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    few = edges.count() <= (ONE_TASK_EDGES if one_task is None else one_task)
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)  # their number never grows
    edges, state = together(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = together(edges.union(edges.select("b", "a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = together(written(together(small.union(least.select("a", "m"))).where("a <> b").distinct()))
    heads = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(heads)


def stars(members: DataFrame) -> DataFrame:
    """bucket, id, pivot of all members (bucket, id) but the pivot, the least. One shuffle; a window streams through its bucket."""
    marked = members.withColumn("pivot", F.min("id").over(Window.partitionBy("bucket")))
    return marked.where("id <> pivot").select("bucket", "id", "pivot")


#: Sketches of two sides (bytes in the last axis) and their sizes to: lower bound of the distance minus what is allowed.
Excess = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a matrix."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def allowed(pairs: DataFrame, sketches: DataFrame, excess: Excess) -> DataFrame:
    """The pairs (a, b) that their sketches (id, size, sketch) don't exclude."""
    side = lambda k: sketches.select(F.col("id").alias(k), F.col("size").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                ok = excess(_bytes(x.column("sa")), _bytes(x.column("sb")), x.column("na").to_numpy(), x.column("nb").to_numpy()) <= 0
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Places of the first row of each group of equal keys but the first one, in the order of all of them."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[1:]])
    return order[new]


def _block_pairs(x: dict[str, np.ndarray], excess: Excess, closest: bool, forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components in one block; of each two components the closest only, if asked for, or (``forest``) of each component."""
    left = np.flatnonzero(x["side"] <= 0)
    whole = not (x["side"] != 0).any()
    right = left if whole else np.flatnonzero(x["side"] >= 0)
    names, counts = np.unique(x["c"], return_counts=True)
    large = x["c"] == names[np.argmax(counts)]  # pairs inside it are connected
    none = np.zeros(0, np.int64)
    out = [(none, none, none)]  # one of two chunks may have no member
    for mine, others in ((left[~large[left]], right), (left[large[left]], none if whole else right[~large[right]])):
        for at in range(0, len(mine) if len(others) else 0, 32):
            rows = mine[at : at + 32]
            ok = (x["c"][rows, None] != x["c"][None, others])
            if whole:
                ok &= large[others][None] | (x["id"][rows, None] < x["id"][None, others])
            over = excess(x["sketch"][rows, None], x["sketch"][None, others], x["size"][rows, None], x["size"][None, others])
            i, j = np.nonzero(ok & (over <= 0))
            out.append((rows[i], others[j], over[i, j]))
    a, b, over = (np.concatenate(v) for v in zip(*out))
    if forest and len(a):
        both, again = np.concatenate([x["c"][a], x["c"][b]]), np.concatenate([over, over])
        first = np.unique(_firsts(again, both) % len(a))
        a, b = a[first], b[first]
    elif closest and len(a):
        first = _firsts(over, np.minimum(x["c"][a], x["c"][b]), np.maximum(x["c"][a], x["c"][b]))
        a, b = a[first], b[first]
    return np.minimum(x["id"][a], x["id"][b]), np.maximum(x["id"][a], x["id"][b])


def across(parts: DataFrame, sketches: DataFrame, excess: Excess, closest: bool, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) of ``parts`` (bucket, id, c, n members of the bucket) that aren't excluded."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("id"), chunks).cast("int")
    rows = parts.join(sketches, "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "id", "c", "size", "sketch")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    names = ["side", "id", "c", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        last = None

        def finished() -> pa.RecordBatch:
            a, b = _block_pairs({k: np.concatenate([h[k] for h in held]) for k in held[0]}, excess, closest, forest)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ["bucket", "i", "j", *names]} | {"sketch": _bytes(batch.column("sketch"))}
            change = np.flatnonzero((x["bucket"][1:] != x["bucket"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])) + 1
            for s, e in zip([0, *change], [*change, batch.num_rows]):
                key = (x["bucket"][s], x["i"][s], x["j"][s])
                if held and key != last:
                    yield finished()
                    held = []
                held.append({k: x[k][s:e] for k in [*names, "sketch"]})
                last = key
        if held:
            yield finished()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(members: DataFrame, sketch: Callable[[DataFrame], DataFrame], excess: Excess, verify: Callable[[DataFrame], DataFrame], keep: Scratch) -> DataFrame:
    """Links (a, b) enough to connect all ids that links connect.

    ``members``: bucket, id. ``sketch(ids)``: id, size and
    sketch of the ids that can occur in pairs; ``excess`` bounds a pair's distance by them. ``verify(pairs)``
    returns those of the distinct pairs (a, b) that are linked. Tables are kept by ``keep``.
    """
    star = keep(stars(members))
    ids = keep(star.select("id").union(star.select("pivot")).distinct())
    sketches = keep(sketch(ids))
    near = keep(allowed(star.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), sketches, excess))
    found = keep(verify(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    labels = keep(components(found))
    apart = near
    for k in ("a", "b"):
        named = sized(labels.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")))
        apart = apart.join(named, k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    more = keep(verify(apart.where("ca <> cb").select("a", "b")))
    if more.take(1):
        found = found.union(more)
        labels = keep(components(found))
    both = star.select("bucket", "id").union(star.groupBy("bucket").agg(F.first("pivot").alias("id")))
    tested = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for closest, forest in ((False, True), (True, False), (False, False)):
        parts = both.join(sized(labels.withColumnRenamed("component", "c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
        # buckets of two have no pair that isn't tested
        mixed = parts.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("bucket", "n")
        pairs = keep(across(parts.join(mixed, "bucket"), sketches, excess, closest, forest))
        new = keep(pairs.join(tested, ["a", "b"], "left_anti"))
        more = keep(verify(new))
        if more.take(1):
            found = found.union(more)
            labels = keep(components(found))
        elif not pairs.take(1):
            break
        tested = tested.union(new)
    return found
