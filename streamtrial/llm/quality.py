"""Quality rules: hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed to ``BUCKETS`` buckets. Two multinomials are counted, each with one added
to every bucket: the raw corpus (all documents) and the trusted target (a bounded sample of documents
labelled good). A document's score is the sum of ``log p_target - log p_raw`` over its n-grams, divided by
their number; it is kept if base rules hold and the score is at least ``threshold``. Every document is
judged by the same counts and threshold, so the verdict doesn't depend on order or partitions.

Base figures: words ``[^\\x20\\x09-\\x0D]+``, code points in words, characters of ``[#*$%&|<>]``, lines with a word
that equal an earlier line, words inside 8-word windows that occur twice or more in the text. A document
fails the base rules with fewer than 20 words, or if over 30 % of its words are in repeated windows.

Defined cases: a null text has no words and fails; an empty table gives no rows; without trusted rows all
scores are 0. Repeated rows count as often as they occur and get equal results, as the verdict is a threshold on each document's own
score and not a rank, so ties play no part; very long texts count whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000
#: At most so many trusted documents, those with the least hash of their id, make the target.
TARGET_ROWS = 20_000
THRESHOLD = -0.06
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8


def _pairs(h: Column, gap: int) -> Column:
    """Element i: hash of elements i and i + gap; as many as there are."""
    n = F.greatest(F.size(h) - gap, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def with_grams(docs: DataFrame) -> DataFrame:
    """Adds ``_words``, and the hashes ``_h1`` of words and ``_h2`` of word pairs."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return docs.withColumn("_words", words).withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_h2", _pairs(F.col("_h1"), 1))


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Per bucket the n-grams of all documents (``raw``) and of the trusted ones (``target``)."""
    ids = trusted.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).withColumn("_good", F.lit(1))
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")  # at most TARGET_ROWS ids
    grams = with_grams(flagged).select("_good", F.explode(F.concat("_h1", "_h2")).alias("_h"))
    return grams.groupBy(F.pmod("_h", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count("_good").alias("target"))


def log_ratios(counts: DataFrame) -> list[float]:
    """``log p_target - log p_raw`` of each bucket (BUCKETS rows come to the driver)."""
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for r, t in zip(raw, target)]


def repeated_words(h8: Column, sorted8: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``sorted8``: the windows as sorted (h, i)."""
    h = lambda j: F.get(sorted8, j)["h"]
    again = F.filter(sorted8, lambda x, j: F.coalesce(h(j - 1) == x["h"], F.lit(False)) | F.coalesce(h(j + 1) == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]


def base_figures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (and the helper columns)."""
    text = F.coalesce("text", F.lit(""))
    df = with_grams(docs).withColumn("_h4", _pairs(F.col("_h2"), 2)).withColumn("_h8", _pairs(F.col("_h4"), 4))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda v: v.rlike("[^\\x20\\x09-\\x0D]")))
    repeats = F.size(F.array_distinct("_h8")) < F.size("_h8")
    windows = F.transform("_h8", lambda v, i: F.struct(v.alias("h"), i.alias("i")))
    df = df.withColumn("_s8", F.when(repeats, F.sort_array(windows)))
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_s8").isNull(), F.lit(0)).otherwise(repeated_words(F.col("_h8"), F.col("_s8"))).cast("long"),
    }).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, ``llr`` (mean log ratio of the n-grams) and ``kept``, for every row of ``docs``."""
    table = ",".join(map(repr, log_ratios(bucket_counts(docs, trusted))))
    ratios = F.split(F.lit(table), ",").cast("array<double>")
    add = lambda a, h: a + F.get(ratios, F.pmod(h, F.lit(BUCKETS)).cast("int"))
    total = F.aggregate("_h2", F.aggregate("_h1", F.lit(0.0), add), add)
    df = base_figures(docs.select("doc_id", "text")).withColumn("llr", total / F.greatest(F.size("_h1") + F.size("_h2"), F.lit(1)))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", kept.alias("kept"))
