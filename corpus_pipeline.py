"""A corpus pipeline of five stages over documents; each stage's result is written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.llm.bpe import bpe_round_trip, digests
from terravela.llm.decontaminate import drop_contaminated
from terravela.llm.exact_dedup import drop_copies
from terravela.llm.language_id import filter_languages, fit_language_model
from terravela.llm.ngram_join import drop_near_copies
from terravela.plans.lineage import fresh_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in any language; learned as in op7 from the rows it isn't tested on. Mixed ones stay."""
    learned_from = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return filter_languages(docs, fit_language_model(learned_from), least_share=0.0)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return drop_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(bpe_round_trip(docs, path, pattern))


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", decontaminate), ("byte_level_bpe", encode)]

#: Language ID isn't expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
