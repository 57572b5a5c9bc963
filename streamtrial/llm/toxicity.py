"""Toxicity by a classifier chain.

The chain predicts categories in order. Each link is a logistic regression on the words of a text and
on the log odds of the categories before it. Only words whose frequency differs clearly between the
classes (chi-square of at least ``LEAST_CHI2``) have weights, so the many neutral words of a long text don't
outweigh a few telling ones. A link is trained with out-of-fold log odds of the earlier
ones (each fold's come from a model that has not seen it), so it meets the same kind of input as later,
when full models feed it. Words are runs of letters in lower case; a word counts once in a text.

The fit uses a bounded sample of labelled rows: per combination of labels the ``STRATUM_ROWS`` rows with the
least hash of their id, in full length. They stream through the driver, which keeps word numbers only. Scoring
covers every whole text.

Defined cases: a null or empty text is scored by the bias alone; repeated labels of an id count as their
maximum; a row with a null label is left out of the fit; rows of the documents that have a label's id are all
learned from; ties of hashes are settled by the id; without labelled rows, or with one class only, a category's
probability is that class's share (0 without rows); an empty table gives no rows; very long texts count like others;
kept columns may have any name but those of the probabilities, which is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import bounded, slices

STRATUM_ROWS, FOLDS, LEAST_TEXTS, LEAST_CHI2, STEPS = 3000, 3, 3, 20.0, 120
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Link:
    category: str
    bias: float
    weights: np.ndarray  # per word of the vocabulary
    earlier: np.ndarray  # per earlier category


@dataclass
class Chain:
    words: dict[str, int]
    links: list[Link]


def bag(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _fit(idx: np.ndarray, ptr: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int, l2: float = 0.3) -> tuple[float, np.ndarray, np.ndarray]:
    """Class-balanced logistic regression by accelerated gradient steps scaled per feature."""
    n, share = len(y), y.mean() if len(y) else 0.0
    if n == 0 or share in (0.0, 1.0):
        return (20.0 if share else -20.0), np.zeros(size), np.zeros(extra.shape[1])
    row = np.repeat(np.arange(n), np.diff(ptr))
    pull = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    with_word, positive = np.bincount(idx, minlength=size), np.bincount(idx, y[row], size)
    expected = with_word * share
    chi2 = (positive - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9) * n / np.maximum(n - with_word, 1)
    told = (chi2 >= LEAST_CHI2)[idx]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row[told], minlength=n))])
    idx, row = idx[told], row[told]
    # a bound of the curvature of each coordinate when all features of a row move together
    load = np.diff(ptr) + 1.0 + np.abs(extra).sum(1)
    step = 1.0 / (0.25 * np.bincount(idx, (pull * load)[row], size) + l2)
    step_x = 1.0 / (0.25 * (np.abs(extra) * (pull * load)[:, None]).sum(0) + l2)
    step_b = 1.0 / (0.25 * (pull * load).sum())
    w, x, b = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    wv, xv, bv = w.copy(), x.copy(), b
    for t in range(STEPS):
        z = bv + extra @ xv + np.bincount(row, wv[idx], n)
        g = pull * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        w1 = wv - step * (np.bincount(idx, g[row], size) + l2 * wv)
        x1 = xv - step_x * (extra.T @ g + l2 * xv)
        b1 = bv - step_b * g.sum()
        m = t / (t + 3)
        wv, xv, bv = w1 + m * (w1 - w), x1 + m * (x1 - x), b1 + m * (b1 - b)
        w, x, b = w1, x1, b1
    return b, w, x


def numbered(texts: Iterable[str | None]) -> tuple[dict[str, int], list[np.ndarray]]:
    """Numbers of the words that ``LEAST_TEXTS`` texts have, in the order of the words, and those of each text, ascending."""
    first: dict[str, int] = {}
    rows = [np.fromiter((first.setdefault(w, len(first)) for w in bag(t)), np.int32) for t in texts]
    count = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=len(first))
    words = {w: i for i, w in enumerate(sorted(w for w, k in first.items() if count[k] >= LEAST_TEXTS))}
    place = np.full(len(first), -1, np.int64)
    for w, i in words.items():
        place[first[w]] = i
    return words, [np.sort(p[p >= 0]) for p in (place[r] for r in rows)]


def train(texts: Iterable[str | None], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """The chain over the categories of ``labels``, in their order."""
    return chained(*numbered(texts), labels, folds)


def chained(words: dict[str, int], rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    idx = np.concatenate([*rows, np.zeros(0, np.int64)])
    lens = np.diff(ptr)
    row = np.repeat(np.arange(len(rows)), lens)

    def part(mask: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return _fit(idx[mask[row]], np.concatenate([[0], np.cumsum(lens[mask])]), extra[mask], y[mask], len(words))

    links, extra = [], np.zeros((len(rows), 0))
    for category, y in labels.items():
        y = y.astype(float)
        odds = np.zeros(len(rows))
        for k in range(FOLDS):
            b, w, x = part(folds != k, extra, y)
            z = b + extra @ x + np.bincount(row, w[idx], len(rows))
            odds[folds == k] = np.clip(z, -8, 8)[folds == k]
        links.append(Link(category, *part(np.ones(len(rows), bool), extra, y)))
        extra = np.column_stack([extra, odds])
    return Chain(words, links)


def predict(chain: Chain, texts: list[str | None]) -> np.ndarray:
    """Probabilities, a row per text and a column per category."""
    get = chain.words.get
    out = np.zeros((len(texts), len(chain.links)))
    weights = np.stack([k.weights for k in chain.links]) if chain.links else np.zeros((0, 0))
    for i, text in enumerate(texts):
        ids = [j for j in map(get, bag(text)) if j is not None]
        base = weights[:, ids].sum(1) if ids else np.zeros(len(weights))
        odds: list[float] = []
        for k, link in enumerate(chain.links):
            z = link.bias + base[k] + float(np.dot(link.earlier, odds))
            odds.append(min(8.0, max(-8.0, z)))
            out[i, k] = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column]) -> Chain:
    """A chain from documents (doc_id, text) and label rows; ``categories``: name to a 0/1 column of ``labels``."""
    names = list(categories)
    flat = labels.select("doc_id", *[c.cast("int").alias(k) for k, c in categories.items()]).dropna()
    flat = flat.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in names])
    # most rows are left out by a threshold of their hash, so that what is ordered by combination is little
    sizes = flat.groupBy(*names).agg(F.least(F.lit(1.0), (1.2 * STRATUM_ROWS + 200) / F.count("*")).alias("_share"))
    some = flat.withColumn("_hash", F.xxhash64("doc_id")).join(F.broadcast(sizes), names).where(F.pmod("_hash", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    first = Window.partitionBy(*names).orderBy("_hash", "doc_id")
    chosen = some.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= STRATUM_ROWS).select("doc_id", *names)
    # at most STRATUM_ROWS ids for each of the few label combinations: small enough for every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    told: dict[str, list[int]] = {k: [] for k in names}

    def texts() -> Iterator[str | None]:
        for r in rows.toLocalIterator():
            for k in names:
                told[k].append(r[k])
            yield r.text

    words, bags = numbered(texts())
    return chained(words, bags, {k: np.array(v, float) for k, v in told.items()}, np.arange(len(bags)) % FOLDS)


def score(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default ``doc_id``) with a probability ``p_<category>`` each."""
    spark = bounded(docs.sparkSession)
    model = spark.sparkContext.broadcast(chain)
    keep = keep or ["doc_id"]
    names = [f"p_{k.category}" for k in chain.links]
    if clash := {*keep} & {*names}:
        raise ValueError(f"kept columns have the names of probabilities: {sorted(clash)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), "text")
    schema = rows.select("r").withColumns({k: F.lit(0.0) for k in names}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = predict(model.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("r"), *[pa.array(c) for c in p.T]], names=["r", *names])

    return rows.mapInArrow(run, schema).select(*[F.col(f"r.`{c}`").alias(c) for c in keep], *names)


def without_category(docs: DataFrame, chain: Chain, category: str, at: float) -> DataFrame:
    """The rows of ``docs``, with their columns, whose probability of ``category`` is below ``at``."""
    spark = bounded(docs.sparkSession)
    model = spark.sparkContext.broadcast(chain)
    column = [k.category for k in chain.links].index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(predict(model.value, part.column("text").to_pylist())[:, column] < at))

    return docs.mapInArrow(run, docs.schema)
