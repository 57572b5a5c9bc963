"""Document fingerprints by locally consistent parsing.

A text is cut into phrases again and again. On each level runs of one symbol are named first; then
deterministic coin tossing (the lowest bit in which a symbol differs from its left neighbour, repeated
until six labels are left, then three) marks local maxima of the labels and minima between them as phrase
starts. Where a phrase starts depends on a few neighbours only, so equal substrings get equal phrase
names apart from their ends, wherever they stand. A phrase's name is a hash of its symbols' names.
The signature of a text is the set of its names on ``LEVELS``; the fingerprint holds the ``SKETCH``
least of them, and the likeness of two fingerprints is the share of the least names of both that are
common (bottom-k estimate of the sets' Jaccard similarity).

Defined cases: null counts as empty; an empty text has an empty fingerprint, two of them have likeness 1,
one and another text 0. Equal texts have equal fingerprints. Rows with equal ids follow each other in the
order of a hash of their text, and of equal rows either may come first, with the same results; null ids come first; a table of one row is its
own successor; very long texts are parsed whole; other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.llm.common import SLICE_BYTES, bounded, mix32

LEVELS, SKETCH = (2, 3), 48
_STEP = np.uint32(0x9E3779B1)
_POWERS = np.multiply.accumulate(np.full(16, _STEP, np.uint32), dtype=np.uint32)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing down to labels 0, 1, 2, of which neighbours in one text differ."""
    label = x
    for bits in (32, 7, 4, 3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ label.dtype.type(1)
        low = np.bitwise_count(~(label ^ left) & ((label ^ left) - label.dtype.type(1)))
        label = (low << 1) | ((label >> low.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8)
    left, right = np.empty_like(label), np.empty_like(label)
    for v in (3, 4, 5):
        left[1:], right[:-1] = label[:-1], label[1:]
        left[first] = 9
        right[np.append(first[1:], len(label)) - 1] = 9
        at = np.flatnonzero(label == v)
        a, b = left[at], right[at]
        label[at] = np.where((a != 0) & (b != 0), 0, np.where((a != 1) & (b != 1), 1, 2))
    return label


def next_level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text and the texts' first places; ``first``: where texts start (none is empty)."""
    new = np.empty(len(x), bool)
    new[:1] = True
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x))).astype(np.uint32)
    first = np.searchsorted(at, first)
    x = x[at]
    many = run > 1
    x[many] = mix32(x[many] ^ mix32(run[many]))
    label = _labels(x, first).astype(np.int8)
    left, right = np.full(len(x), -1, np.int8), np.full(len(x), -1, np.int8)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[first] = -1
    right[np.append(first[1:], len(x)) - 1] = -1
    top = (label > left) & (label > right)
    near = top.copy()
    near[1:] |= top[:-1]
    near[:-1] |= top[1:]
    start = top | ((label < left) & (label < right) & ~near)
    start[first] = True
    at = np.flatnonzero(start)
    nth = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    return mix32(np.add.reduceat(mix32(x) * _POWERS[nth & 15], at, dtype=np.uint32)), np.searchsorted(at, first)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The least names of each text in ascending order."""
    lengths = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(lengths)
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not len(full):
        return out
    x = mix32(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1))
    first = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
    found = []
    for level in range(1, max(LEVELS) + 1):
        x, first = next_level(x, first)
        if level in LEVELS:
            text = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(first, len(x))))
            found.append((text << np.uint64(32)) | mix32(x + np.uint32(level)).astype(np.uint64))
    keys = np.unique(np.concatenate(found))
    ends = np.searchsorted(keys >> np.uint64(32), np.arange(len(full) + 1, dtype=np.uint64))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for i, a, b in zip(full, ends[:-1], ends[1:]):
        out[i] = low[a : min(b, a + SKETCH)]
    return out


def written_out(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    left, right = set(a.tolist()), set(b.tolist())
    if len(a) < SKETCH and len(b) < SKETCH:  # both are whole sets
        return len(left & right) / len(left | right)
    least = sorted(left | right)[:SKETCH]
    return sum(v in left and v in right for v in least) / SKETCH


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many code points from the head of ``following``."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, _own) so dealt and sorted that each row with ``_own`` is followed, in its partition, by its successor.

    Ranges of ids between quantiles are dealt out; a row without ``_own`` is a copy of the head of the range that follows.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_k"))
    cuts = min(4096, 2 * parts)
    found = rows.agg(F.percentile_approx("_k", [i / cuts for i in range(cuts)], 20 * cuts).alias("q")).first().q
    bounds = sorted(set(found or [0]))
    heads = F.array(*[F.lit(b) for b in bounds])
    own = F.size(F.filter(heads, lambda b: b <= F.col("_k"))) - 1
    rows = rows.withColumn("_r", own)
    before = (F.col("_r") + (len(bounds) - 1)) % len(bounds)
    mine = F.struct(F.col("_r").cast("int").alias("r"), F.lit(True).alias("own"))
    head = F.struct(before.cast("int").alias("r"), F.lit(False).alias("own"))
    rows = rows.withColumn("_p", F.explode(F.when(F.array_contains(heads, F.col("_k")), F.array(mine, head)).otherwise(F.array(mine))))
    rows = rows.select("doc_id", "text", "_k", F.col("_p.r").alias("_r"), F.col("_p.own").alias("_own"), F.xxhash64("text").alias("_h"))
    dealt = rows.repartitionById(len(bounds), F.col("_r"))
    return dealt.sortWithinPartitions("_r", F.col("_own").desc(), "_k", "_h").select("doc_id", "text", "_own")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all ``rows`` (doc_id, text, own) but the last, which is the successor of the one before."""
    texts = [r[1] for r in rows]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, new = sketches(texts), sketches(changed)
    out = []
    for i, text in enumerate(changed):
        if rows[i][2]:
            sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((rows[i][0], len(texts[i]), sha, written_out(own[i]), written_out(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1])))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to it and to the next document."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(row)
                size += len(row[1])
                if size > SLICE_BYTES // 2 and len(held) > 1:
                    yield _finished(held)
                    held, size = [row], len(row[1])
        if len(held) > 1:
            yield _finished(held)

    return in_order(docs).mapInArrow(run, SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document only: doc_id, fingerprint."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(written_out, sketches(texts)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").withColumn("fingerprint", F.lit("")).schema)
