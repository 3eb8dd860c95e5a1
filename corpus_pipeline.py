"""A corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Each stage works on what the one before it kept.  All but the last return the
columns of ``documents``; the last returns the places of all pieces.  Stages
accept nulls in any column, empty tables and further columns, which are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketyield.llm import packing, pii, quality, simhash_dedup, toxicity
from basketyield.llm.common import free_names, small_batches, table
from basketyield.llm.queries import NOT_HELD_OUT
from basketyield.llm.word_ids import default_path
from basketyield.stage import Stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are likelier target text than not."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), NOT_HELD_OUT)
    names = free_names(docs, "log_weight", "quality_score")
    return quality.score(docs, model, names).where(F.col(names[1]) >= quality.THRESHOLD).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents below the toxicity threshold."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), NOT_HELD_OUT)
    names = free_names(docs, "toxicity", "passages")
    return toxicity.score(docs, model, names).where(F.col(names[0]) < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    small_batches(spark)
    return simhash_dedup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows the new text."""
    small_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, default_path())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifiers, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), name)
        if k:
            stage.drop(STAGES[k - 1][0])
    return docs
