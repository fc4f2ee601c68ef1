"""The operators' queries over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.llm import chat, embeddings, media, minhash, mixing, oracles, packing, quality, scoring, substring, wrappers
from locusmill.llm.common import table


def op1_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op3_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return chat.chat_digests(turns.unionByName(own))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pstable_vectors": op1_pstable_vectors,
    "op2_ogg_media": op2_ogg_media,
    "op3_wrapper_text": op3_wrapper_text,
    "op4_attention_scores": op4_attention_scores,
    "op5_chat_windows": op5_chat_windows,
    "op6_compression_quality": op6_compression_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_weighted_fair_mixing": op8_weighted_fair_mixing,
    "op9_probminhash": op9_probminhash,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE: dict[str, str] = {"op1_pstable_vectors": oracles.VECTORS, "op8_weighted_fair_mixing": oracles.MIXING, "op10_substring_dedup": oracles.REPEATS}
