"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import bpe, brown, chat, hnsw, langid, lines, mixing, quality, repair, simhash, suffix, urls, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "weight", "probability", "kept")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.cut_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_copies(table(spark, sf_dir, "embeddings"))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.demo(spark, table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_turns(turns.union(more)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(bpe.RANKS)
    return bpe.encode(table(spark, sf_dir, "documents"), path).drop("ids")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents")).drop("kept")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_lines": op3_lines,
    "op4_hnsw": op4_hnsw,
    "op5_brown": op5_brown,
    "op6_quality": op6_quality,
    "op7_urls": op7_urls,
    "op8_chat": op8_chat,
    "op9_bpe": op9_bpe,
    "op10_suffix": op10_suffix,
    "op11_variants": op11_variants,
    "op12_repair": op12_repair,
    "op13_langid": op13_langid,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_lines": lines.ORACLE,
    "op7_urls": urls.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_variants": variants.ORACLE,
    "op12_repair": repair.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
