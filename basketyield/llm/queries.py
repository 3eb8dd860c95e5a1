"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import Stage
from . import (
    ann,
    byte_bpe,
    conversations,
    fingerprints,
    lexical_search,
    minhash_dedup,
    packing,
    pii,
    quality,
    sharding,
    simhash_dedup,
    token_file,
    toxicity,
)
from .common import table
from .word_ids import default_path


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, written in id order, and read back."""
    path = Stage(spark).path("token_file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), path, default_path(), end_id=1)
    return token_file.read_token_file(spark, path, digest=True)


#: Labels are learned only from these rows.
NOT_HELD_OUT = "crc32(cast(doc_id as string)) % 4 <> 2"


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), NOT_HELD_OUT)
    return toxicity.score(docs, model).select(
        "doc_id",
        (~F.expr(NOT_HELD_OUT)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and class, and a draw of half of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), NOT_HELD_OUT)
    scored = quality.score(docs, model).select("doc_id", "log_weight", F.col("quality_score").alias("score"))
    drawn = quality.resample(scored, fraction=0.5)
    return drawn.withColumn("accepted", F.col("score") >= quality.THRESHOLD)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path(), end_id=1, capacity=4096)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by bytes of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), sharding.SHARD_BYTES)


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_study(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, what is wrong with them, and the cheapest repair."""
    return conversations.digests(*conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    registered = (
        op1_token_file,
        op2_toxicity,
        op3_simhash_dedup,
        op4_quality_resampling,
        op5_best_fit_packing,
        op6_sharding,
        op7_pii_crf,
        op8_fingerprints,
        op9_byte_bpe,
        op10_ann,
        op11_conversation_repair,
        op12_minhash_dedup,
        op13_lexical_search,
        pipeline,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_sharding": sharding.oracle_sql(sharding.SHARD_BYTES),
        "op11_conversation_repair": conversations.oracle_sql(),
        "op12_minhash_dedup": minhash_dedup.oracle_sql(),
        "op13_lexical_search": lexical_search.oracle_sql(),
    }
