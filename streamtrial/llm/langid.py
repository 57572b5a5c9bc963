"""Language identification by cross-parsing entropy.

Per language, a suffix automaton over labelled text holds all its substrings. A text is cross-parsed
against it: each phrase is the longest match from where the last one ended, so a text in the same
language needs few phrases. ``phrases * log2(training bytes) / bytes`` estimates the cross entropy in bits
per byte; the language with the least wins, ties go to the smaller name.

Text is lower-cased UTF-8 in which each run of ASCII non-letters is one blank. Blocks of ``BLOCK`` bytes are
parsed side by side, each as if a phrase began with it. Then every block is parsed again with the phrase that
its predecessor left open, until both parses are in the same state (the state decides all that follows), so a
very long text is parsed as a whole but takes no longer steps than many short ones.

The labelled sample is bounded: per language the ``SAMPLE_ROWS`` rows with the least hash of their text, and of each
a span of ``LANGUAGE_BYTES / SAMPLE_ROWS`` bytes (less with over ``ALL_BYTES / LANGUAGE_BYTES`` languages, more with fewer
rows), which begins at a place told by the hash.

Defined cases: a null or empty text, or one without a letter, gives ``und`` and score 0; so does every
text when nothing labelled could be learned. Repeated rows get equal results; null ids are kept; an empty table gives no
rows; kept columns may have any name but ``lang_pred`` and ``score``, which is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import bounded, slices, string_parts

UNDETERMINED = "und"
BLOCK = 4096
#: Bounds of the labelled sample: rows per language, bytes per language and over all languages.
SAMPLE_ROWS, LANGUAGE_BYTES, ALL_BYTES = 400, 48_000, 800_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


@dataclass
class Model:
    names: list[str]
    symbol: np.ndarray  # byte -> column of the tables; bytes never seen share column 0, which matches nothing
    table: np.ndarray  # (next state << 2) | phrases that the step ends; states are offsets of rows
    roots: np.ndarray
    weight: np.ndarray  # log2 of the training bytes


def normalised(data: np.ndarray) -> np.ndarray:
    data = _FOLD[data]
    blank = data == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return data[keep]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


def build(samples: dict[str, bytes]) -> Model:
    """The model of normalised text per language."""
    names = sorted(k for k, v in samples.items() if v)
    seen = sorted(set(b"".join(samples[k] for k in names)))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width, tables, roots, base = len(seen) + 1, [], [], 0
    for name in names:
        nexts = automaton(samples[name])
        table = np.full((len(nexts), width), -1, np.int64)
        for s, step in enumerate(nexts):
            for c, t in step.items():
                table[s, symbol[c]] = (base + t * width) << 2
        restart = np.where(table[0] >= 0, table[0] + 1, (base << 2) + 2)  # after a miss inside a phrase
        rows = np.where(table >= 0, table, restart)
        rows[0] = np.where(table[0] >= 0, table[0], (base << 2) + 1)  # an unknown byte alone
        tables.append(rows.ravel())
        roots.append(base)
        base += rows.size
    table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
    if base < 1 << 29:
        table = table.astype(np.int32)
    weight = np.log2([len(samples[k]) + 1.0 for k in names])
    return Model(names, symbol.astype(table.dtype), table, np.array(roots, table.dtype), weight)


def sample(labelled: DataFrame) -> dict[str, bytes]:
    """A bounded sample per language, chosen by a hash of the text."""
    rows = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    per = max(2000, min(LANGUAGE_BYTES, ALL_BYTES // max(1, sizes.count())))
    # most rows are left out by a threshold of their hash, so that what is ordered by language is little
    share = F.least(F.lit(1.0), (1.5 * SAMPLE_ROWS + 100) / F.col("n"))
    some = rows.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))  # a row per language
    span = F.ceil(2 * per / F.least("n", F.lit(SAMPLE_ROWS))).cast("int")  # of characters; blanks are folded
    start = F.pmod(F.shiftright("h", 31), F.greatest(F.lit(1), F.length("text") - span + 1)) + 1
    some = some.select("lang", "h", "n", F.lower(F.substring("text", start, span)).alias("text")).distinct()
    first = Window.partitionBy("lang").orderBy("h", "text")
    out: dict[str, list[bytes]] = {}
    for r in some.withColumn("at", F.row_number().over(first)).where(F.col("at") <= SAMPLE_ROWS).orderBy("lang", "at").toLocalIterator():
        own = -(-per // min(r.n, SAMPLE_ROWS))
        out.setdefault(r.lang, []).append(normalised(np.frombuffer(r.text.encode(), np.uint8)).tobytes()[:own])
    return {k: b" ".join(v)[:per] for k, v in out.items()}


def phrases(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases that each text (a column) needs against each language (a row)."""
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(starts)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(lengths[text] - nth * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")
    at, size, text, nth = (starts[text] + nth * BLOCK)[order], size[order], text[order], nth[order]
    state = np.repeat(model.roots[:, None], len(at), axis=1)
    count = np.zeros(state.shape, np.int32)
    alive = len(at) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    steps = []
    for i, k in enumerate(alive):
        step = model.table[state[:, :k] + symbols[at[:k] + i]]
        steps.append(step)
        count[:, :k] += step & 3
        state[:, :k] = step >> 2
    # the place of each block's predecessor; first blocks have none
    place = np.empty(len(text), np.int64)
    place[np.lexsort((nth, text))] = np.arange(len(text))
    by_place = np.argsort(place)
    later = np.flatnonzero(nth > 0)
    before = by_place[place[later] - 1]
    entry, end, change = np.repeat(model.roots[:, None], len(later), axis=1), state.copy(), np.zeros(state.shape, np.int32)
    while True:
        new = end[:, before]
        row, col = np.nonzero(new != entry)
        if not len(row):
            break
        entry[row, col] = new[row, col]
        now, b = entry[row, col], later[col]
        change[row, b], end[row, b] = 0, state[row, b]
        row, b = row.copy(), b.copy()
        for i in range(BLOCK):
            inside = i < size[b]
            end[row[~inside], b[~inside]] = now[~inside]
            row, b, now = row[inside], b[inside], now[inside]
            if not len(row):
                break
            step, plain = model.table[now + symbols[at[b] + i]], steps[i][row, b]
            change[row, b] += (step & 3) - (plain & 3)
            now = step >> 2
            apart = now != plain >> 2
            row, b, now = row[apart], b[apart], now[apart]
        else:
            end[row, b] = now
    last = np.ones(len(text), bool)
    last[before] = False
    count += change + (last & (end != model.roots[:, None]))
    out = np.zeros((len(model.names), len(starts)), np.int64)
    for row, c in zip(out, count):
        row += np.bincount(text, c, len(starts)).astype(np.int64)
    return out


def judged(model: Model, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of lower-cased texts; score: the runner-up's share of the two least entropies, 1 without one."""
    data, starts, lengths = string_parts(texts)
    folded = _FOLD[data]
    blank = folded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    before = np.concatenate([[0], np.cumsum(keep)])
    at, size = before[starts], before[starts + lengths] - before[starts]
    name, score = [UNDETERMINED] * len(starts), np.zeros(len(starts))
    if model.names:
        bits = phrases(model, model.symbol[folded[keep]], at, size) * model.weight[:, None] / np.maximum(size, 1)
        best = np.argmin(bits, axis=0)
        low = np.sort(bits, axis=0)
        share = low[1] / np.maximum(low[0] + low[1], 1e-300) if len(low) > 1 else np.ones(len(starts))
        for i in np.flatnonzero(letters & (size > 0)):
            name[i], score[i] = model.names[best[i]], share[i]
    return name, score


def identify(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default ``doc_id``) with ``lang_pred`` and ``score``, learned from ``labelled`` (text, lang)."""
    spark = bounded(docs.sparkSession)
    model = spark.sparkContext.broadcast(build(sample(labelled)))
    keep = keep or ["doc_id"]
    if clash := {*keep} & {"lang_pred", "score"}:
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r")
    rows = docs.select(kept, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"), F.lower("text").alias("text"))
    schema = rows.select("r").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            name, score = judged(model.value, part.column("text"), part.column("letter").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column("r"), pa.array(name, pa.string()), pa.array(score)], names=["r", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select(*[F.col(f"r.`{c}`").alias(c) for c in keep], "lang_pred", "score")
