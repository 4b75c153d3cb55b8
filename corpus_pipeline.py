"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens. Counted as part of tidewater.llm.

Every stage takes and returns whole tables. A stage's rows are written and read again before the next one starts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, lines, mixing, quality, similar
from tidewater.llm.common import Cuts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; every document stays, and n_chars follows its text."""
    return lines.drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the document with the smallest id stays."""
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target shares of sources, languages and topics."""
    return mixing.sample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    path = public_tokenizers.path(bpe.RANKS)
    return bpe.encode(docs, path).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]

#: Fingerprints and rank tables have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cuts = Cuts(spark)
    for _, stage in STAGES[:-1]:
        docs = cuts.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
