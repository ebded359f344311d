"""The operators over their whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm import (
    byte_bpe,
    chat_format,
    fill_in_middle,
    licenses,
    mixing,
    ngram_lm,
    order_minhash,
    projection_dedup,
    quality,
    spelling,
    suffix_dedup,
    token_counts,
    toxicity,
)
from jobtrail.llm.common import table
from jobtrail.session import configure

Query = Callable[[SparkSession, str], DataFrame]
TOKEN_LIMIT = 2048


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(configure(spark), sf_dir, "documents")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *base, F.round("posterior", 6).alias("posterior"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans_of(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"),
    )


def op10_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(table(configure(spark), sf_dir, "embeddings"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(configure(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # One conversation more, whose texts hold marks of the template.
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.digests(chat_format.format_conversations(given.unionByName(planted)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(documents(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_order_minhash": op6_order_minhash,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_projection_dedup": op10_projection_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op11_chat_format": chat_format.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
