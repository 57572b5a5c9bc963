"""A corpus pipeline of five stages; each works on all rows that the one before it kept.

Defined cases, for every stage: a null text counts as empty, null labels, sources and languages are values like others; rows of
one id and text are one document, which stays or goes with all its rows; rows without an id are never a copy of another; very long
texts are worked on whole; other columns are handed on, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtrial.llm import jaccard, linededup, mixing, packing, toxicity
from streamtrial.llm.common import written
from streamtrial.llm.linking import sized
from streamtrial.llm.queries import TOXIC_AT, tokenizer_path, toxicity_chain

#: Share of the tokens that mixing may take, once each.
MIX_FRACTION = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.without_category(docs, toxicity_chain(spark, sf_dir), "toxic", TOXIC_AT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of lines connected by few edits (``linededup``) the first stays, so a line cut may be near it only through others; documents of which nothing is left go."""
    return linededup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles (Jaccard 0.8 or more) the document with the least id stays."""
    groups = written(jaccard.join(docs, n=5, num=8, den=10)[0].where("component_id <> doc_id").select("doc_id"))
    return docs.join(sized(groups), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights on each level; what short sources lack goes to their siblings."""
    return mixing.mix(docs, fraction=MIX_FRACTION, epochs=1, keep=docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and edit distances over whole tables have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
