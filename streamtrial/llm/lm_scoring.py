"""Language-model scoring by masked pseudo-likelihood.

A network with a window of ``SIDE`` tokens on both sides predicts each token from the others: token vectors
of the window, one tanh layer, and a softmax in two steps. The ``FREQUENT`` most frequent words of the corpus are in
``GROUPS`` groups of ``WORDS`` each, by rank; all others are in ``RARE`` hash classes. The first step predicts the group or
class, the second the word in its group. A rare word's probability is that of its class times its share of the class,
which comes from the counts of all words of the corpus (``SMOOTH`` added to each, and to one unseen word per class). The
shares of the ``KNOWN`` most frequent words are sent along; a document's other words are joined with the table of
words. Without that table ``score`` gives the classes' part only. A document's score is the sum of the log
probabilities of its tokens, each given both sides; the mean per token is comparable between documents.

Word counts and class frequencies come from all documents. Texts are then read once more: their classes are dealt by a hash of the
text to parts of about ``PART_TOKENS`` tokens and stored in the order of that hash; training and scoring read these. In each round every part
starts from the same weights and takes numpy gradient steps on its masked tokens; the rounds share out
the ``MASK`` places (shifted by a hash of the document), so that every token of every document is masked once,
given its true neighbours. The weights of the parts are then averaged
in Spark, weighted by their tokens (parameter mixing), ``FAN`` at a time. So what is gathered grows with the corpus, while
what reaches the driver is a few sets of weights. The result depends on the texts alone, not on files, tasks or
their timing.

Defined cases: a null or empty text has 0 tokens, log_prob 0 and mean null; an empty table gives no rows;
repeated rows train as often as they occur and score alike; words of equal counts are ranked by their hash; very long texts are
worked on whole; kept columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.llm.common import Scratch, bounded, mix64, slices, span_hashes, string_parts, word_spans, written

GROUPS, WORDS, RARE, SIDE, WIDTH, HIDDEN = 32, 128, 32, 2, 8, 24
FREQUENT = GROUPS * WORDS
CLASSES, TOP = FREQUENT + RARE, GROUPS + RARE
#: Words (the most frequent) whose shares of their class are sent to every task.
KNOWN = 1 << 17
#: Added to each word's count in its class. Log shares are summed as whole numbers of 1 / UNITS, so their order doesn't matter.
SMOOTH, UNITS = 0.1, 1 << 24
BORDER = CLASSES
MASK, ROUNDS, STEP_ROWS, RATE = 16, 2, 4096, 2.0
#: Places that are scored at a time.
SCORE_ROWS = 4096
#: Tokens of a part, and sets of weights that one task averages.
PART_TOKENS, FAN = 500_000, 16
#: Tokens that a task holds at once; a single longer text is still worked on whole.
SLICE_TOKENS = 1 << 18
#: A group's weights move by the mean gradient of its words in a step, or as if they were so many.
LEAST_GROUP = 32
SHAPES = {
    "vectors": (CLASSES + 1, WIDTH), "hidden": (2 * SIDE * WIDTH, HIDDEN), "shift": (HIDDEN,), "out": (HIDDEN, TOP), "bias": (TOP,),
    "inner": (GROUPS, HIDDEN, WORDS), "inner_bias": (GROUPS, WORDS),
}
#: The group or rare class of each token.
_TOP = np.append(np.repeat(np.arange(GROUPS), WORDS), np.arange(GROUPS, TOP))

#: Places of each class's numbers among all vectors.
_CELLS = np.arange((CLASSES + 1) * WIDTH).reshape(-1, WIDTH)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (ASCII upper case folded), and the number of words of each text."""
    data, starts, lengths = string_parts(texts)
    # a blank after each text keeps its last word apart from the next text's first
    glued = np.full(len(data) + len(lengths), 32, np.uint8)
    glued[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = _LOWER[data]
    a, b = word_spans(glued)
    ends = np.cumsum(lengths + 1)
    count = np.diff(np.concatenate([[0], np.searchsorted(a, ends)]))
    return span_hashes(glued, a, b), count


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            word, n = np.unique(word_hashes(part.column("text"))[0].view(np.int64), return_counts=True)
            for a in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(word[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["word", "n"])

    bounded(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Class of a word hash: its place among the frequent words, or FREQUENT + hash mod RARE."""

    def __init__(self, frequent: list[int]):
        words = np.array(frequent, np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.place = words[order], order.astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        rare = (FREQUENT + (hashes % np.uint64(RARE))).astype(np.int32)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.place[at], rare)


def windows(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with SIDE borders around each text, and the places of the true tokens in it."""
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(classes)) + SIDE * (2 * text + 1)
    padded = np.full(len(classes) + 2 * SIDE * len(counts), BORDER, np.int32)
    padded[at] = classes
    return padded, at


_OFFSETS = np.array([d for d in range(-SIDE, SIDE + 1) if d])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def start(class_counts: np.ndarray) -> np.ndarray:
    """First weights: small fixed random values, and the log frequencies as biases."""
    rng = np.random.default_rng(7)
    parts = [rng.normal(0, 0.3, s).ravel() for s in (SHAPES["vectors"], SHAPES["hidden"])]
    share = (class_counts + 1.0) / (class_counts.sum() + CLASSES)
    top = np.bincount(_TOP, share, TOP)
    bias, inner = np.log(top), np.log(share[:FREQUENT] / np.repeat(top[:GROUPS], WORDS))
    small = [rng.normal(0, 0.05, SHAPES[k]).ravel() for k in ("out", "inner")]
    return np.concatenate([*parts, np.zeros(HIDDEN), small[0], bias, small[1], inner]).astype(np.float32)


def forward(net: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.take(net["vectors"], context, axis=0).reshape(len(context), -1)
    h = np.tanh(x @ net["hidden"] + net["shift"])
    return x, h, h @ net["out"] + net["bias"]


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z - top) in place, its sums per row, and the top of each row: one for all if no row vanishes by it, else the row's own."""
    ones, top = np.ones(z.shape[1], z.dtype), z.max(initial=0.0)
    e = np.exp(z - top)
    sums = e @ ones
    if sums.min(initial=1.0) > 1e-30:
        return e, sums, np.full(len(z), top, z.dtype)
    top = z.max(1)
    np.exp(z - top[:, None], out=e)
    return e, e @ ones, top


def grouped(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the places in which the words of a group follow each other, and (group, first, end) of those that occur."""
    group = np.minimum(target // WORDS, GROUPS).astype(np.int16)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(GROUPS), side="right").tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def log_probabilities(net: dict[str, np.ndarray], padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.float32)
    for a in range(0, len(at), SCORE_ROWS):
        own = at[a : a + SCORE_ROWS]
        order, groups = grouped(padded[own])
        own = own[order]
        target = padded[own]
        _, h, z = forward(net, padded[own[:, None] + _OFFSETS])
        logs = z[np.arange(len(own)), _TOP[target]]
        _, sums, top = exponentials(z)
        logs -= np.log(sums) + top
        for g, b, e in groups:
            z = h[b:e] @ net["inner"][g] + net["inner_bias"][g]
            word = z[np.arange(e - b), target[b:e] % WORDS]
            _, sums, top = exponentials(z)
            logs[b:e] += word - np.log(sums) - top
        out[a + order] = logs
    return out


def learn(net: dict[str, np.ndarray], padded: np.ndarray, at: np.ndarray, rate: float) -> None:
    """Gradient steps over the masked places ``at``."""
    for a in range(0, len(at), STEP_ROWS):
        own = at[a : a + STEP_ROWS]
        order, groups = grouped(padded[own])
        own = own[order]
        context, target = padded[own[:, None] + _OFFSETS], padded[own]
        x, h, z = forward(net, context)
        z, sums, _ = exponentials(z)
        z *= (rate / len(own) / sums)[:, None].astype(np.float32)
        z[np.arange(len(own)), _TOP[target]] -= rate / len(own)
        back = z @ net["out"].T
        for g, b, e in groups:
            mine = h[b:e]
            y, sums, _ = exponentials(mine @ net["inner"][g] + net["inner_bias"][g])
            y /= sums[:, None]
            y[np.arange(e - b), target[b:e] % WORDS] -= 1
            back[b:e] += (y @ net["inner"][g].T) * np.float32(rate / len(own))
            y *= np.float32(rate / max(e - b, LEAST_GROUP))
            net["inner"][g] -= mine.T @ y
            net["inner_bias"][g] -= y.sum(0)
        back *= 1 - h * h
        into = (back @ net["hidden"].T).ravel()
        net["out"] -= h.T @ z
        net["bias"] -= z.sum(0)
        net["hidden"] -= x.T @ back
        net["shift"] -= back.sum(0)
        cells = np.take(_CELLS, context, axis=0).ravel()
        net["vectors"] -= np.bincount(cells, into, net["vectors"].size).reshape(net["vectors"].shape).astype(np.float32)


def shifts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the masked places of each text start: a hash of its first word and length."""
    first, full = np.cumsum(counts) - counts, counts > 0
    out = np.zeros(len(counts), np.uint64)
    out[full] = mix64(hashes[first[full]] + counts[full].astype(np.uint64))
    return out


def masked_places(shift: np.ndarray, counts: np.ndarray, turn: int) -> np.ndarray:
    """Places masked in round ``turn``, one of MASK sets after the other; over all rounds each token is masked once."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    which = (place.astype(np.uint64) + np.repeat(shift, counts)) % np.uint64(MASK)
    own = np.flatnonzero(which % np.uint64(ROUNDS) == turn)
    return own[np.argsort(which[own], kind="stable")]


CODES = "text_key long, n_tokens long, shift long, classes binary, known_log double, others array<long>, times array<int>"


def encoded(docs: DataFrame, keep: list[str], words: list[int], shares: Shares | None = None) -> DataFrame:
    """r (the ``keep`` columns), text_key, n_tokens, shift, classes (two bytes a token), known_log (the log shares of known rare words), others and times (rare words without a known share, and how often)."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((words, shares))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), F.xxhash64("text").alias("text_key"), "text")
    kind = rows.select("r").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = Classes(shared.value[0]), shared.value[1]
        for part in slices(batches):
            hashes, counts = word_hashes(part.column("text"))
            tokens, n = classes(hashes), part.num_rows
            text, word = np.repeat(np.arange(n), counts), hashes.view(np.int64)
            rare = tokens >= FREQUENT
            text, word = text[rare], word[rare]
            had, logs = known(word) if known else (np.ones(len(word), bool), np.zeros(len(word)))
            known_log = np.bincount(text, logs, n).astype(float)
            pairs = np.stack([text[~had], word[~had]])
            pairs, times = np.unique(pairs, axis=1, return_counts=True) if pairs.size else (pairs, np.zeros(0, np.int64))
            offsets = pa.array(np.searchsorted(pairs[0], np.arange(n + 1)).astype(np.int32))
            ends = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(tokens.astype("<i2")))])
            columns = [part.column("r"), part.column("text_key"), pa.array(counts.astype(np.int64)), pa.array(shifts(hashes, counts).view(np.int64)), codes, pa.array(known_log)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pairs[1], times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + lists, names=["r", *[f.split()[0] for f in CODES.split(", ")]])

    return rows.mapInArrow(run, f"r {kind['r'].dataType.simpleString()}, {CODES}")


def parts_of(tokens: int) -> int:
    return max(1, -(-tokens // PART_TOKENS))


def dealt(codes: DataFrame, parts: int) -> DataFrame:
    """The codes with their part, a part after the other and each in the order of its texts' hashes: as a stored table a part is a file."""
    own = F.pmod(F.xxhash64("text_key"), F.lit(parts)).cast("int")
    rows = codes.withColumn("part", own).repartitionById(parts, F.col("part"))
    return rows.sortWithinPartitions("part", "text_key", "n_tokens")


def _bounded_rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``most`` tokens together, one row at least."""
    ends, at = np.cumsum(batch.column("n_tokens").to_numpy()), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, and the number of each row's."""
    column = batch.column("classes").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat.view("<i2").astype(np.int32), batch.column("n_tokens").to_numpy()


def trained_round(codes: DataFrame, flat: np.ndarray, rate: float, turn: int, parts: int) -> np.ndarray:
    """Round ``turn`` over all documents: the parts' weights, averaged by their masked tokens. ``codes``: with part, a part's rows together."""
    shared = codes.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, net, seen = None, None, 0

        def told() -> pa.RecordBatch:
            out = np.concatenate([net[k].ravel() for k in SHAPES]).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([out.tobytes()])], names=["part", "seen", "weights"])

        for batch in batches:
            own = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if own[a] != part:
                    if seen:
                        yield told()
                    part, net, seen = int(own[a]), unpacked(shared.value), 0
                for rows in _bounded_rows(batch.slice(a, b - a), SLICE_TOKENS):
                    classes, counts = _codes(rows)
                    padded, at = windows(classes, counts)
                    masked = at[masked_places(rows.column("shift").to_numpy().view(np.uint64), counts, turn)]
                    learn(net, padded, masked, rate)
                    seen += len(masked)
        if seen:
            yield told()

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        seen = table.column("seen").to_numpy()
        total = sum(n * np.frombuffer(w.as_py(), np.float64) for n, w in zip(seen.tolist(), table.column("weights")))
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "seen": pa.array([int(seen.sum())]), "weights": pa.array([(total / seen.sum()).tobytes()])})

    weights = codes.select("part", "n_tokens", "shift", "classes").mapInArrow(run, "part int, seen long, weights binary")
    while parts > 1:
        weights = weights.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(mean, "part int, seen long, weights binary")
        parts = -(-parts // FAN)
    found = weights.collect()  # one, or none without tokens
    return np.frombuffer(bytes(found[0].weights), np.float64).astype(np.float32) if found else flat


def vocabulary(counts: DataFrame) -> tuple[list[int], np.ndarray, int]:
    """The frequent words' hashes, the first weights, and the number of tokens, from word counts."""
    rare = F.lit(FREQUENT) + F.pmod("word", F.lit(RARE))
    frequent = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    totals = np.zeros(CLASSES)
    for r in counts.groupBy(rare.cast("int").alias("c")).agg(F.sum("n").alias("n")).collect():
        totals[r.c] = r.n
    tokens = int(totals.sum())
    for i, (word, n) in enumerate(frequent):
        totals[i] = n
        totals[FREQUENT + word % RARE] -= n
    return [w for w, _ in frequent], start(totals), tokens


def _rounds(codes: DataFrame, flat: np.ndarray, parts: int) -> np.ndarray:
    for i in range(ROUNDS):
        flat = trained_round(codes, flat, RATE / (1 + i), i, parts)
    return flat


def train(docs: DataFrame, counts: DataFrame | None = None) -> tuple[list[int], np.ndarray]:
    """The frequent words' hashes and the network's weights, learned from all documents; ``counts``: their word counts, if at hand."""
    counts = written(word_counts(docs)) if counts is None else counts
    words, flat, tokens = vocabulary(counts)
    with Scratch(docs.sparkSession) as keep:
        return words, _rounds(keep(dealt(encoded(docs.withColumn("_n", F.lit(0)).select("_n", "text"), ["_n"], words).drop("r"), parts_of(tokens))), flat, parts_of(tokens))


def class_totals(counts: DataFrame, words: list[int]) -> np.ndarray:
    """Per rare class the smoothed count of its words and of an unseen one."""
    total = np.full(RARE, SMOOTH)
    told = counts.where(~F.col("word").isin(words)) if words else counts
    for r in told.groupBy(F.pmod("word", F.lit(RARE)).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[r.c] += r.n + SMOOTH * r.v
    return total


class Shares:
    """Log shares in their classes of the rare words among the most frequent words of the corpus, at most KNOWN."""

    def __init__(self, known: list[tuple[int, int]], frequent: list[int], total: np.ndarray):
        rare = sorted((w, n) for w, n in known if w not in set(frequent))
        self.words = np.array([w for w, _ in rare], np.int64)
        n = np.array([n for _, n in rare], float)
        self.logs = np.log((n + SMOOTH) / total[(self.words % RARE).astype(np.int64)])

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is one of them, and its log share, else 0."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return known, np.where(known, self.logs[at], 0.0)


def shares_of(counts: DataFrame, words: list[int]) -> tuple[Shares, np.ndarray]:
    """The shares that are sent along, and the smoothed counts of the rare classes."""
    total = class_totals(counts, words)
    return Shares([(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()], words, total), total


def rare_logs(codes: DataFrame, total: np.ndarray, counts: DataFrame) -> DataFrame:
    """text_key, rare_log: sum of the log shares of a text's other rare words in their classes."""
    name = F.pmod("word", F.lit(RARE)).cast("int")
    share = F.log((F.coalesce("n", F.lit(0)) + SMOOTH) / F.get(F.array(*[F.lit(float(v)) for v in total]), name))
    pairs = codes.select("text_key", F.explode(F.arrays_zip("others", "times")).alias("e")).select("text_key", F.col("e.others").alias("word"), F.col("e.times").alias("k"))
    sums = pairs.join(counts, "word", "left").groupBy("text_key").agg(F.sum(F.col("k") * F.round(share * UNITS).cast("long")).alias("logs"))
    # copies of a text have one key and have been summed up together
    copies = codes.groupBy("text_key").agg(F.count("*").alias("copies"))
    return sums.join(copies, "text_key").select("text_key", (F.col("logs") / F.col("copies") / UNITS).alias("rare_log"))


def scored(codes: DataFrame, keep: list[str], flat: np.ndarray, total: np.ndarray | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The ``keep`` columns, n_tokens, log_prob, mean_log_prob of encoded documents."""
    shared = codes.sparkSession.sparkContext.broadcast(flat)
    schema = codes.select("r", "text_key", "n_tokens").withColumn("class_log", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unpacked(shared.value)
        for batch in batches:
            for rows in _bounded_rows(batch, SLICE_TOKENS):
                classes, counts = _codes(rows)
                logs = log_probabilities(net, *windows(classes, counts)).astype(float)
                out = rows.column("known_log").to_numpy().copy()
                full = counts > 0
                if full.any():
                    out[full] += np.add.reduceat(logs, (np.cumsum(counts) - counts)[full])
                yield pa.RecordBatch.from_arrays([rows.column("r"), rows.column("text_key"), rows.column("n_tokens"), pa.array(out)], names=["r", "text_key", "n_tokens", "class_log"])

    out = codes.select("r", "text_key", "n_tokens", "classes", "known_log").mapInArrow(run, schema)
    log_prob = F.col("class_log")
    if counts is not None:
        out = out.join(rare_logs(codes, total, counts), "text_key", "left")
        log_prob = log_prob + F.coalesce("rare_log", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens"))
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in keep], "n_tokens", log_prob.alias("log_prob"), mean.alias("mean_log_prob"))


def score(docs: DataFrame, model: tuple[list[int], np.ndarray], keep: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``keep`` columns (default doc_id), n_tokens, log_prob, mean_log_prob of every document by a model that was trained before.

    ``counts`` (word, n of the corpus): rare words are scored as words; without it as classes.
    """
    keep = keep or ["doc_id"]
    shares, total = shares_of(counts, model[0]) if counts is not None else (None, None)
    return scored(encoded(docs, keep, model[0], shares), keep, model[1], total, counts)


def pseudo_likelihood(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The same for the documents that the model is trained on: they are encoded once for training and scoring."""
    keep = keep or ["doc_id"]
    counts = written(word_counts(docs))
    words, flat, tokens = vocabulary(counts)
    shares, total = shares_of(counts, words)
    codes = written(dealt(encoded(docs, keep, words, shares), parts_of(tokens)))
    return scored(codes, keep, _rounds(codes, flat, parts_of(tokens)), total, counts)
