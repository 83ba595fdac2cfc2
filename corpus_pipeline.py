"""The corpus pipeline: five operators one after another over ``documents``.

Each stage takes what its predecessor kept, and its result is written before the
next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import jaccard, langid, linededup, packing, queries, toxicity
from marketloom.llm.common import crc32_mod, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A language is accepted when its mean probability over a text's bytes is at least this.
LEAST_LANGUAGE_SCORE = 0.5
#: Bytes of words that packing keeps a process, beside what the stages before it have left there.
CACHE_BYTES = 48 << 20
#: A document is toxic from this score on.
TOXIC_SCORE = 0.3


def _learnable() -> Column:
    return F.coalesce(crc32_mod(F.col("doc_id"), 4) != 2, F.lit(False))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose language is known well enough; nothing is shuffled."""
    verdict = langid.verdicts(spark, langid.train(docs.where(_learnable())))
    known = (F.col("_v.lang_pred") != "und") & (F.col("_v.score") >= LEAST_LANGUAGE_SCORE)
    return docs.withColumn("_v", verdict(F.col("text"))).where(known).select(*COLUMNS)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that score under the threshold; nothing is shuffled."""
    labels = table(spark, sf_dir, "labels")
    score = toxicity.scores(spark, toxicity.train(docs, labels.where(_learnable())))
    return docs.withColumn("_s", score(F.col("text"))["score"]).where(F.col("_s") < TOXIC_SCORE).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each near-duplicate group's document with the smallest id.

    Rows that share an id go only together; rows with a null id, which no id tells apart, stay.
    """
    found = jaccard.near_duplicates(docs, k=5, percent=80).where(F.col("doc_id").isNotNull())
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select(F.col("doc_id").alias("node"))
    return jaccard.without(docs.withColumn("node", F.col("doc_id")), written(gone, "near-duplicates")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, queries.tokenizer_path("word_bpe_49k.json"), cache_bytes=CACHE_BYTES)


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("line dedup", without_repeated_lines),
    ("near duplicates", one_of_each_group),
    ("packing", packed),
]

#: Models and tokenizers are not expressible in SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
