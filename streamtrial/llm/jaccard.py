"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word shingles (hashes). Sets are put in bands of sizes in which the largest
is at most ``1 / threshold`` of the least, so sets of similarity ``threshold`` or more lie in one band or in
two that follow each other; every set has signatures for its own band and for the next. In a band such
sets differ in at most ``k`` elements. A hash splits the domain of the shingles into ``k // 2 + 1 + spare``
partitions, and each of them into three of the second level. At least ``1 + spare`` partitions then hold one
difference at most, so two of their three second-level partitions are equal: all three subsets of two are
enumerated, and each gives a signature of band, partition, subset and the elements in it. A subset without
elements says nothing, so it gives none, unless more than ``spare`` of a set's partitions have such a subset:
then the empty ones are signatures too. Two sets of which one has at most ``spare`` such partitions share a
signature of an equal subset that isn't empty; otherwise both have signatures for their empty ones. So no similar
pair is missed.

Equal sets are one class from the start; signatures are made for one document of each class, and pairs
are tested exactly, if their sketches allow it: counts of elements in each of ``SKETCH`` partitions, whose sum of
differences is at most the sets' distance. The texts of pairs to test meet in groups of a document and up to
``PARTNERS`` others. Links within a bucket are found as in ``linking``.

Defined cases: null and empty texts, and those without words, have size 0 and are linked with nothing; fewer words
than a shingle has count as one shingle; rows with the same id are one document, which is linked by each of
their texts and has the size of the largest; rows without id, which no component could name, get no row; very
long texts are worked on whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.llm.common import Scratch, bounded, mix64, slices, span_hashes, string_parts, word_spans, written
from streamtrial.llm.linking import BROADCAST_BYTES, components, links, sized

#: Bytes of a set's sketch, and documents that one is held against in a group.
SKETCH, PARTNERS = 256, 256
#: Spare partitions that keep random sets of a band from meeting by empty subsets may be one for so many needed.
SPARE_PART = 6
#: Columns that tell equal sets.
SET = ("set_hash", "set_check")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and the number of each text's."""
    data, starts, lengths = string_parts(texts)
    glued = np.full(len(data) + len(lengths), 32, np.uint8)
    glued[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = _LOWER[data]
    a, b = word_spans(glued)
    words = span_hashes(glued, a, b)
    first = np.concatenate([[0], np.searchsorted(a, np.cumsum(lengths + 1))])
    out, sizes = [], np.zeros(len(lengths), np.int64)
    factor = [np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(n)]
    joined = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        joined += words[i : i + len(joined)] * factor[i]
    joined = mix64(joined)
    for k in range(len(lengths)):
        s, e = first[k], first[k + 1]
        if e - s >= n:
            own = np.unique(joined[s : e - n + 1])
        elif e > s:
            own = mix64(np.add.reduce(words[s:e] * np.array(factor[: e - s], np.uint64), dtype=np.uint64, keepdims=True) + np.uint64(e - s))
        else:
            continue
        out.append(own)
        sizes[k] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def bands(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, largest size in it) of the band of ``size`` and of the next; threshold num / den."""
    band, low = 0, 1
    while (high := low * den // num) < size:
        band, low = band + 1, high + 1
    following = (high + 1) * den // num
    return [(band, high), (band + 1, following)]


def partitions(high: int, num: int, den: int) -> tuple[int, int]:
    """First-level partitions of a band with sets of at most ``high``, and the spare ones among them; (0, 0): only equal sets are similar.

    With intersection I and union U, I / U >= num / den: U - I <= (den - num) / (den + num) * (|a| + |b|).
    """
    k = (den - num) * 2 * high // (den + num)
    if not k:
        return 0, 0
    need = k // 2 + 1

    def weak(least: float, parts: int) -> float:
        """Partitions with an empty subset of a random set of ``least`` elements, with three deviations."""
        empty = math.exp(-least / parts / 3)  # of a second-level partition
        mean = parts * (3 * empty**2 * (1 - empty) + empty**3)
        return mean + 3 * math.sqrt(mean) if mean > 0.01 else 0

    # the least set that has signatures here is the least of the band below
    for spare in range(need // SPARE_PART + 1):
        if weak(high * (num / den) ** 2, need + spare) <= spare:
            return need + spare, spare
    # small sets would need more: sketches tell them apart
    spare = math.ceil(weak(high * num / den, need))
    return need + spare, spare


def signatures(values: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set (place) of each."""
    used = np.flatnonzero(sizes)
    per = sizes[used]
    rules = {int(s): [(band, *partitions(high, num, den)) for band, high in bands(int(s), num, den)] for s in np.unique(per)}
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    element = mix64(values)
    within = (element >> np.uint64(11)).astype(np.uint64)
    for turn in (0, 1):
        band, parts, spare = (np.array([rules[int(s)][turn][i] for s in per], np.int64) for i in range(3))
        whole = parts == 0  # one signature of all elements
        cells = np.where(whole, 1, 3 * parts)
        base = np.cumsum(cells) - cells
        place = np.repeat(base, per) + (within % np.repeat(cells, per).astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(total, place, mix64(element + np.uint64(1)))
        filled = np.zeros(len(total), bool)
        filled[place] = True
        one = base[whole]
        out.append(mix64(total[one] + mix64(band[whole].astype(np.uint64) * np.uint64(1 << 32) + np.uint64(3))))
        owner.append(used[whole])
        first = np.repeat(base[~whole], parts[~whole]) + 3 * (np.arange(parts.sum()) - np.repeat((np.cumsum(parts) - parts)[~whole], parts[~whole]))
        own = np.repeat(np.arange(len(used)), parts)
        empty = np.stack([~filled[first + i] for i in range(3)]) if len(first) else np.zeros((3, 0), bool)
        keep_empty = (np.bincount(own[empty.sum(0) >= 2], minlength=len(used)) > spare)[own]
        label = mix64(band[own].astype(np.uint64) * np.uint64(1 << 32) + ((first - base[own]) // 3 * 4).astype(np.uint64) + np.uint64(7))
        for i, j in ((0, 1), (0, 2), (1, 2)):
            keep = ~(empty[i] & empty[j]) | keep_empty
            both = total[first[keep] + i] + mix64(total[first[keep] + j] + np.uint64(13)) + label[keep] + np.uint64(i + j)
            out.append(mix64(both))
            owner.append(used[own[keep]])
    return np.concatenate(out), np.concatenate(owner)


def sketches_of(docs: DataFrame, n: int) -> DataFrame:
    """id, size, sketch of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, sizes = shingle_sets(part.column("text"), n)
            place = np.repeat(np.arange(len(sizes)) * SKETCH, sizes) + (mix64(values + np.uint64(11)) % np.uint64(SKETCH)).astype(np.int64)
            counts = np.bincount(place, minlength=SKETCH * len(sizes)).astype(np.uint8)
            rows = [r.tobytes() for r in counts.reshape(-1, SKETCH)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(rows, pa.binary())], names=["id", "size", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, size long, sketch binary")


def heads_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles, and two hashes of the set, set_hash and set_check, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, sizes = shingle_sets(part.column("text"), n)
            ends, hashed = np.cumsum(sizes), []
            for salt in (5, 0x6A09E667F3BCC909):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values + np.uint64(salt)), dtype=np.uint64)])
                hashed.append(pa.array(mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(sizes), *hashed], names=["doc_id", "text_key", "n_shingles", *SET])

    return docs.select(F.col("doc_id").cast("long"), "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_hash long, set_check long")


def similar(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) in ``rows``: a, part, own (the text is that of a), b, text; groups of a and part are held together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for part in slices(batches):
            values, sizes = shingle_sets(part.column("text"), n)
            ends = np.cumsum(sizes)
            a, deal, own, b = (part.column(k).to_numpy(zero_copy_only=False) for k in ("a", "part", "own", "b"))
            linked = np.zeros(len(a), bool)
            for i in range(len(a)):
                mine = values[ends[i] - sizes[i] : ends[i]]
                if (a[i], deal[i]) != key:
                    key, sets = (a[i], deal[i]), []
                if own[i]:
                    sets.append(mine.copy())
                for other in () if own[i] else sets:
                    at = np.searchsorted(other, mine)
                    common = int((other[np.minimum(at, len(other) - 1)] == mine).sum()) if len(other) else 0
                    linked[i] |= common > 0 and den * common >= num * (len(other) + len(mine) - common)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[linked]), pa.array(np.maximum(a, b)[linked])], names=["a", "b"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("own").desc())
    return dealt.select("a", "part", "own", "b", "text").mapInArrow(run, "a long, b long").distinct()


def members_of(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """bucket, id of the signatures of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bucket, own = signatures(*shingle_sets(part.column("text"), n), num, den)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[own] if len(own) else np.zeros(0, np.int64)
            for a in range(0, len(bucket), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 100_000].view(np.int64)), pa.array(ids[a : a + 100_000])], names=["bucket", "id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, id long")


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, n_shingles, class_id, component_id; and links (a, b) between class representatives that connect the components.

    ``class_id``: least id with the same set. The similarity threshold is ``num / den``.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    with Scratch(spark) as keep:
        heads = keep(heads_of(docs, n))
        full = heads.where("n_shingles > 0")
        firsts = full.groupBy(*SET, "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
        # only copies that aren't the first of their class are left out
        again = full.join(firsts.where("copies > 1"), [*SET, "n_shingles"]).where("doc_id <> class_id").select("doc_id", "text_key", "class_id").distinct()
        again = written(again)
        single = docs.join(sized(again.select("doc_id", "text_key")), ["doc_id", "text_key"], "left_anti").select("doc_id", "text")
        if 16 * again.count() > BROADCAST_BYTES:
            single = keep(single)  # else every use would shuffle the texts

        def sketch(ids: DataFrame) -> DataFrame:
            rows = sketches_of(single.join(sized(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi"), n)
            # a document of several texts can't be excluded by one of them
            several = F.when(F.min("sketch") != F.max("sketch"), F.lit(1 << 40)).otherwise(F.max("size"))
            return rows.groupBy("id").agg(several.alias("size"), F.min("sketch").alias("sketch"))

        def excess(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
            return np.minimum(d := a - b, b - a, out=d).sum(-1, dtype=np.uint32).astype(np.int64) - (den - num) * (na + nb) // (den + num)

        def verify(pairs: DataFrame) -> DataFrame:
            pairs = keep(pairs)
            parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
            dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(False).alias("own"), "b")
            owners = dealt.select("a", "part", F.lit(True).alias("own"), F.col("a").alias("b")).distinct()
            roles = keep(dealt.union(owners))
            return similar(single.join(sized(roles.withColumnRenamed("b", "doc_id")), "doc_id").withColumnRenamed("doc_id", "b"), n, num, den)

        found = links(members_of(single, n, num, den), sketch, excess, verify, keep)
        several = heads.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo < hi")
        same = again.join(several, "doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))  # texts of one document
        found = written(found.union(same).distinct())
        labels = written(components(found))
        rows = written(heads.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")))
    rows = rows.join(sized(again.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    rows = rows.join(sized(labels.select(F.col("id").alias("class_id"), "component")), "class_id", "left")
    return rows.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")), found
