"""The pipeline's stages in a row, on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest

from streamtrial.llm.common import written


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows, labels = [], []
    for i in range(160):
        bad = i % 8 == 0
        rows.append((i, prose(50) + (" idiot clown moron" if bad else ""), "en", f"src{i % 4}"))
        labels.append((i, 1, int(bad)))
    near = prose(120).split()
    for k in range(4):
        own = list(near)
        own[10 * k] = "changed"
        rows.append((200 + k, " ".join(own), "de", "src1"))
    rows += [(300 + k, prose(20) + "\n" + passage, "en", "src2") for k in range(5)] + [(400, rows[1][1], "en", "src3"), (401, None, None, None), (402, "", "en", "src0")]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), rows, passage


def test_stages(spark, corpus):
    top, rows, passage = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, top))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns, name
        if name == "line dedup":
            assert sum(passage in (r.text or "") for r in docs.collect()) == 1
    every = {r[0] for r in rows}
    assert every - kept[0] == set(range(0, 160, 8))
    assert kept[0] - kept[1] == {400}  # an exact copy has no line left
    assert kept[1] - kept[2] == {201, 202, 203}
    assert kept[3] < kept[2] and len(kept[3]) > 0.8 * len(kept[2]) and kept[4] == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, top).collect()} == kept[4]


def test_empty_and_repeated_rows(spark, corpus, tmp_path):
    """Rows of one id and text are one document, and stay or go together; no documents give no pieces."""
    top, _, _ = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    docs.union(docs.where("doc_id in (3, 8, 200, 201)")).write.parquet(f"{tmp_path}/twice/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("twice", "none"):
        spark.read.parquet(f"{top}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/twice").where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got if r["count"] == 2} == {3, 200} and not {8, 201} & {r.doc_id for r in got}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
