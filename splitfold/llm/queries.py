"""The operators applied to their whole tables, under the names that the driver checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.llm import chunkdedup, embed_dedup, langid, linededup, minhash, mixing, packing, pii, quality, toxicity
from splitfold.llm.common import documents, fold
from splitfold.llm.oracles import SQL


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), ngram=2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.dedup_summary(documents(spark, sf_dir))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(documents(spark, sf_dir))


def op6_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_pii that SQL can say."""
    return pii.base_summary(documents(spark, sf_dir))


def op7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_mixing that SQL can say."""
    return mixing.targets(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_dedup, op2_line_dedup, op3_quality_rules, op4_chunk_dedup, op5_embedding_dedup, op6_pii, op7_mixing, op8_packing, op9_toxicity, op10_language_id]
    return {f.__name__: f for f in [*found, op6_base_spans, op7_targets]}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
