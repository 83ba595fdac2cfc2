"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(9)
    parts = {"en": ["th", "er", "ing", "on", "and"], "de": ["sch", "ung", "ü", "ein", "ge"]}
    line = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 3 else "de"
        lines = [line(lang, 12) for _ in range(4)]
        bad = i % 7 == 0
        if bad:
            words = lines[2].split()
            words[5] = words[8] = "zounds"
            lines[2] = " ".join(words)
        rows.append((i, "\n".join(lines), lang, "s"))
        labels.append((i, 1, int(bad)))
    clean = [r for r in rows if r[0] % 7]
    words = clean[10][1].split(" ")
    words[3] = "changed"
    rows += [(1000, clean[5][1], clean[5][2], "t"), (1001, " ".join(words), clean[10][2], "t"), (1002, None, "en", "t"), (1003, "12 34", "en", "t"), (1004, "", None, None), (None, clean[20][1] + " more", None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, corpus):
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, corpus), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id for r in docs.collect()}
    clean = {i for i in range(400) if i % 7}
    assert not {1002, 1003, 1004} & kept["language"] and clean <= kept["language"]
    assert clean <= kept["toxicity"] and sum(i in kept["toxicity"] for i in range(0, 400, 7)) <= 3
    assert kept["line dedup"] == kept["toxicity"]
    assert clean <= kept["near duplicates"]  # each group's smallest id stays
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, corpus)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept["near duplicates"]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_near_duplicates_leave_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id is not null")
    left = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, corpus).collect()}
    assert not {1000, 1001} & left and {i for i in range(400)} <= left


def test_empty_documents(spark, corpus):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus).count() == 0
