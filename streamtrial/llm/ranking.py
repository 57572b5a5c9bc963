"""Ranked lexical search: accumulators of short lists, then document at a time over the long ones.

Terms are maximal runs of letters, digits and characters beyond ASCII. Documents are tokenised once; what is kept
of each is its length and the counts of terms that an item asks for. By a hash of their ids they are dealt to
shards of about ``SHARD`` documents, and a task holds one shard's lists (document, impact), by document. For each item

1. lists of at most ``1 / SHORT`` of the shard are short: their weighted impacts are summed term at a time into
   accumulators, a single list by document;
2. it then is one more list beside the long ones: each has its greatest value per window of ``WINDOW`` documents, and windows
   whose sum of them can't reach the ten best so far are skipped, in the order of documents. The ten
   greatest accumulators bound from below what the ten best must have, before any long list is opened.

Nothing is left out: a skipped window holds no document of the ten. The tens of all shards are then ranked per item.

Defined cases: null texts and those without a term are no documents for the counts; rows with equal ids are documents of their
own; rows without id count, but have no place in a ranking; items with the same id are one item with the terms of all;
items without id, or without a known term, get no rows; equal scores are ranked by the document's id; very long texts
are worked on whole; other columns are not read; an empty table gives no rows. Items are worked on in blocks of at most
``ITEM_BYTES`` of text (checked), each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import Scratch, bounded, slices, span_hashes, string_parts, written

TOP, SHARD, WINDOW, SHORT = 10, 20_000, 256, 32
ITEM_BYTES = 8 << 20
#: Beyond so many shards the tens are ranked in two steps.
ONE_STEP_SHARDS = 1000
RESULT = "item_id long, shard int, doc_id long, score long"

_TERM = np.zeros(256, bool)
_TERM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _TERM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, start and end of every term, and the text (place) it is in."""
    data, _, lengths = string_parts(texts)
    glued = np.full(len(data) + len(lengths), 32, np.uint8)  # a blank after each text
    glued[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = _LOWER[data]
    inside = np.concatenate([[False], _TERM[glued], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return glued, start, end, np.searchsorted(np.cumsum(lengths + 1), start, side="right")


class Terms:
    """Places of terms in a vocabulary of (bytes), told by two hashes."""

    def __init__(self, terms: list[bytes]):
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        start = ends - [len(t) for t in terms]
        data = np.frombuffer(b"".join(terms), np.uint8)
        first = span_hashes(data, start, ends)
        self.place = np.argsort(first).astype(np.int32)
        self.first, self.second = first[self.place], span_hashes(data, start, ends, 1)[self.place]

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans that are terms of the vocabulary, and their places in it."""
        hashes = span_hashes(data, start, end)
        at = np.minimum(np.searchsorted(self.first, hashes), len(self.first) - 1)
        like = np.flatnonzero(self.first[at] == hashes)
        like = like[self.second[at[like]] == span_hashes(data, start[like], end[like], 1)]
        return like, self.place[at[like]]


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms), terms (places) and their counts, of every row."""
    known = Terms(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, start, end, text = term_spans(part.column("text"))
            found, place = known(data, start, end)
            keys, counts = np.unique(text[found].astype(np.int64) << 32 | place, return_counts=True)
            offsets = pa.array(np.searchsorted(keys >> 32, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys & 0xFFFFFFFF, counts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.bincount(text, minlength=part.num_rows)), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Lists:
    """The lists of one shard: documents (places in the order of ids) and impacts of each term."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        order = np.argsort(term, kind="stable")  # rows come by document
        self.doc, self.impact, self.docs = doc[order], impact[order], docs
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
        self.windows = -(-docs // WINDOW)
        self._starts: dict[int, np.ndarray] = {}
        self._tops: dict[int, np.ndarray] = {}

    def __call__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[term], self.ends[term + 1]
        return self.doc[a:b], self.impact[a:b]

    def starts(self, term: int) -> np.ndarray:
        """Where each window starts in the list."""
        if term not in self._starts:
            self._starts[term] = window_starts(self(term)[0], self.windows)
        return self._starts[term]

    def tops(self, term: int) -> np.ndarray:
        """The greatest impact in each window."""
        if term not in self._tops:
            self._tops[term] = window_tops(self(term)[1], self.starts(term))
        return self._tops[term]


def window_starts(doc: np.ndarray, windows: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(windows + 1) * WINDOW)


def window_tops(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts) - 1, np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(value, starts[full])
    return out


def accumulated(lists: Lists, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Short lists term at a time: the documents in any of them, in order, and their sums."""
    if not short:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, sums = zip(*[(d, w * v) for (d, v), w in ((lists(t), w) for t, w in short)])
    doc, sums = np.concatenate(docs), np.concatenate(sums)
    order = np.argsort(doc, kind="stable")
    doc, sums = doc[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[first], np.add.reduceat(sums, first)


def best(lists: Lists, weights: list[tuple[int, int]], top: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the ``top`` best for terms of these weights (equal scores by place), and how many windows were opened."""
    length = {t: lists.ends[t + 1] - lists.ends[t] for t, _ in weights}
    weights = [(t, w) for t, w in weights if w > 0 and length[t]]
    short = [(t, w) for t, w in weights if length[t] * SHORT <= lists.docs]
    long = [(t, w) for t, w in weights if length[t] * SHORT > lists.docs]
    acc_doc, acc = accumulated(lists, short)
    acc_starts = window_starts(acc_doc, lists.windows)
    most = window_tops(acc, acc_starts)
    for t, w in long:
        most = most + w * lists.tops(t)
    opened = [(*lists(t), lists.starts(t), w) for t, w in long] + [(acc_doc, acc, acc_starts, 1)] * (len(acc) > 0)
    doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = int(np.partition(acc, -top)[-top]) if len(acc) >= top else 1  # what a document must reach
    at, seen = 0, 0
    while True:
        ahead = np.flatnonzero(most[at:] >= need)
        if not len(ahead):
            return doc, score, seen
        w = at + int(ahead[0])
        sums = np.zeros(WINDOW, np.int64)
        for d, v, starts, weight in opened:
            a, b = starts[w], starts[w + 1]
            if a < b:
                sums[d[a:b] - w * WINDOW] += weight * v[a:b]
        found = np.flatnonzero(sums >= need)
        if len(found):
            doc, score = np.concatenate([doc, found + w * WINDOW]), np.concatenate([score, sums[found]])
            order = np.lexsort((doc, -score))[:top]
            doc, score = doc[order], score[order]
            if len(doc) == top:
                need = max(need, int(score[-1]) + 1)  # a later document of the same score ranks lower
        at, seen = w + 1, seen + 1


def _searched(table: DataFrame, shards: int, items: list[tuple[int, list[tuple[int, int]]]], docs: int, total: int, terms: int) -> DataFrame:
    """The best of each shard for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        ids, n = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in ("doc_id", "n"))
        size = np.concatenate([p.column("terms").value_lengths().to_numpy() for p in parts])
        term, tf = (np.concatenate([p.column(k).flatten().to_numpy() for p in parts]).astype(np.int64) for k in ("terms", "counts"))
        doc = np.repeat(np.arange(len(ids)), size)
        m = (10 + 90 * n * docs // total)[doc]
        lists = Lists(term, doc, 1_000_000_000 * tf // (1000 * tf + 8 * m), len(ids), terms)
        shard = parts[0].column("shard")[0].as_py()
        for name, weights in items:
            place, score, _ = best(lists, weights)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(place)), pa.array([shard] * len(place), pa.int32()), pa.array(ids[place]), pa.array(score)], names=[f.split()[0] for f in RESULT.split(", ")])

    dealt = table.where("doc_id is not null and size(terms) > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id").select("shard", "doc_id", "n", "terms", "counts").mapInArrow(run, RESULT)


def _ranked(found: DataFrame, *keys) -> DataFrame:
    order = Window.partitionBy("item_id", *keys).orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _block(docs: DataFrame, items: DataFrame, shards: int | None) -> DataFrame:
    """The ranking of items whose texts together are small enough to be sent to every task."""
    spark, asked = docs.sparkSession, {}
    for r in items.collect():  # at most ITEM_BYTES of text
        data, start, end, _ = term_spans(pa.array([r.text], pa.string()))
        asked.setdefault(r.item_id, set()).update(data[a:b].tobytes() for a, b in zip(start, end))
    names = sorted(set().union(*asked.values()))
    with Scratch(spark) as keep:
        table = keep(counted(docs, names or [b"-"]))  # no term has this one
        told = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total")).first()
        if not names or not told.docs:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        places = {t: i for i, t in enumerate(names)}
        df = {r.term: r["count"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # terms of the items only
        weight = [math.floor(1000 * math.log((2 * told.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names))]
        wanted = [(k, [(places[t], weight[places[t]]) for t in sorted(v)]) for k, v in sorted(asked.items())]
        many = shards or max(-(-told.docs // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = _searched(table, many, wanted, told.docs, told.total, len(names))
        if many > ONE_STEP_SHARDS:
            found = _ranked(found, F.pmod("shard", F.lit(math.isqrt(many)))).drop("rank")
        return written(_ranked(found).select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, shards: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents."""
    bounded(docs.sparkSession)
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = 1 + 2 * size // ITEM_BYTES  # twice as many, as hashes don't deal evenly
    out = [_block(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else items, shards) for i in range(blocks)]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0].select("item_id", "rank", "doc_id", "score")
