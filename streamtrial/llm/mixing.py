"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The leaves of the tree are the combinations of its levels (domain, language, source). From the root down, a
node's budget of tokens goes to its children in proportion to their weights; a child whose subtree holds
less than its part gets all it holds, and what it lacks goes to its siblings by weight. Only what
the whole node lacks is left to the siblings of the node, which had been settled one level above. A leaf's
capacity is its tokens times ``epochs``. In each epoch a leaf's documents are in the order of an md5 of
seed, epoch and id; the leaf gives the documents that fit whole into the head of that sequence of epochs.

Scale: capacities are sums per leaf. The running sum of tokens that decides the head is taken in two
steps: sums per (leaf, epoch, bucket of the order key), a window over those few rows, and then a window
inside the one bucket per leaf that holds the end. So a leaf with a third of all rows is spread over
its buckets, whose number grows with the table.

Defined cases: null levels are a group of their own (shown as ''), null or empty texts have 0 tokens and
are taken if they stand before the end; weights not listed are 1, and a weight of 0 gives nothing; repeated rows (equal ids) are counted
one by one and selected together or not at all, as equal places in an epoch are; very long texts count whole, and one that doesn't fit what is
left of a budget ends the leaf; other columns are not read unless they are to be kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import written

LEVELS = ("domain", "lang", "source")
ROWS_A_BUCKET = 4000


def tokens_of(text: Column) -> Column:
    """Number of words."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source of the given tables: ``d`` and the first digit of its number."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9])", 1), F.lit("")))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    w = F.lit(1)
    for name, value in sorted(weights.get(level, {}).items()):
        w = F.when(F.col(level) == name, F.lit(max(0, int(value)))).otherwise(w)
    return w.cast("double")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], levels=LEVELS) -> DataFrame:
    """``leaves`` (levels, cap) with ``budget`` tokens each; the columns of ``budget`` refer to ``total``, all capacity.

    Within a node children are taken by ascending capacity per weight: a child is full if its capacity per
    weight is at most what is left per weight that is left.
    """
    everything = leaves.agg(F.sum("cap").alias("total"))
    nodes = everything.select(F.least(budget, F.col("total")).cast("double").alias("_given"))
    nodes = nodes.withColumn("_all", F.lit(1))
    above: list[str] = ["_all"]
    leaves = leaves.withColumn("_all", F.lit(1))
    for i, level in enumerate(levels):
        key = [*above, level]
        part = leaves.groupBy(*key).agg(F.sum("cap").cast("double").alias("_cap")).withColumn("_w", _weight(level, weights))
        part = part.join(nodes, above)
        filled_at = F.when(F.col("_w") > 0, F.try_divide("_cap", "_w")).otherwise(F.lit(float("inf")))  # without weight: last, with nothing
        order = Window.partitionBy(*above).orderBy(filled_at, level)
        before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*above)
        part = part.withColumns({"_cap0": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_w0": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_wall": F.sum("_w").over(everyone)})
        part = part.withColumn("_rate", F.try_divide(F.col("_given") - F.col("_cap0"), F.col("_wall") - F.col("_w0")))
        part = part.withColumn("_full", F.col("_cap") <= F.col("_rate") * F.col("_w"))
        # the first child that isn't full sets the rate for all after it
        part = part.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct(filled_at.alias("a"), F.col(level).alias("b"), F.col("_rate").alias("rate")))).over(everyone)["rate"])
        nodes = part.select(*key, F.when(F.col("_full"), F.col("_cap")).otherwise(F.coalesce(F.col("_open") * F.col("_w"), F.lit(0.0))).alias("_given"))
        above = key
    return leaves.join(nodes, above).select(*levels, "cap", F.floor("_given").cast("long").alias("budget"))


def leaves_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (doc_id, lang, source, ...) with the levels of the tree."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    return docs.select(*columns, *[c.alias(f"_{k}") for k, c in levels.items()])


def _dealt(df: DataFrame, last: Column, seed: int) -> DataFrame:
    """Every row once per epoch up to ``last``, with its order key."""
    df = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return df.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def cutoffs(light: DataFrame, fraction: float, epochs: int, seed: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Per leaf that gives anything: levels, and ``last``, the epoch and key of its last selected document.

    ``light``: doc_id, n_tokens and the levels.
    """
    sizes = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    given = budgets(sizes.withColumn("cap", F.col("tokens") * epochs).drop("rows"), F.floor(F.col("total") / epochs * fraction), weights)
    given = given.where("budget > 0").join(sizes, list(LEVELS))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_A_BUCKET))
    last = F.least(F.lit(epochs - 1), F.floor((F.col("budget") - 1) / F.greatest("tokens", F.lit(1))))
    rows = _dealt(light.join(given, list(LEVELS)), last, seed)
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long") * buckets / 0x10000000).cast("int"))
    group = [*LEVELS, "epoch", "_bucket"]
    sums = rows.groupBy(*group).agg(F.sum("n_tokens").alias("_sum"), F.max("_key").alias("_end"), F.first("budget").alias("budget"))
    run = Window.partitionBy(*LEVELS).orderBy("epoch", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
    whole = F.col("_before") + F.col("_sum") <= F.col("budget")
    ends = sums.where(whole).select(*LEVELS, F.struct(F.col("epoch"), F.col("_end").alias("key")).alias("last"))
    split = sums.where(~whole & (F.col("_before") <= F.col("budget"))).select(*group, "_before")
    inside = rows.join(split, group)
    upto = F.col("_before") + F.sum("n_tokens").over(Window.partitionBy(*group).orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("_upto", upto).where("_upto <= budget").select(*LEVELS, F.struct(F.col("epoch"), F.col("_key").alias("key")).alias("last"))
    return ends.union(inside).groupBy(*LEVELS).agg(F.max("last").alias("last"))


def mix(docs: DataFrame, fraction: float = 0.5, epochs: int = 1, seed: int = 17, weights: dict[str, dict[str, int]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The selected rows, once per epoch that takes them: doc_id and ``epoch``, or else the ``keep`` columns only.

    ``docs``: doc_id, text, lang, source. The budget is ``fraction`` of all tokens; ``weights``: level to name to weight.
    """
    light = written(leaves_of(docs, ["doc_id", tokens_of(F.col("text")).alias("n_tokens")]).select("doc_id", "n_tokens", *[F.col(f"_{k}").alias(k) for k in LEVELS]))
    ends = cutoffs(light, fraction, epochs, seed, weights or {})
    rows = leaves_of(docs, [F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("_row"), "doc_id"])
    ends = ends.select("last", *[F.col(k).alias(f"_{k}") for k in LEVELS])
    dealt = _dealt(rows.join(ends, [f"_{k}" for k in LEVELS]), F.col("last.epoch"), seed)
    taken = dealt.where((F.col("epoch") < F.col("last.epoch")) | (F.col("_key") <= F.col("last.key")))
    return taken.select(*[F.col("_row")[c].alias(c) for c in keep]) if keep else taken.select("doc_id", "epoch")
