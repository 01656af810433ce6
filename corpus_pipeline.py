"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import decontamination, jaccard_join, language, packing, passages
from clausemill.llm.storage import Scratch, collect_garbage, small_batches


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length that a changed text has now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that starts without the garbage of the one before in the executors, and sends texts in small batches: the session keeps that setting, for the result is written after the stage returns."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_lean
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those in which no language has three tenths of the words; mixed ones stay."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.fit(docs.where(fold != 2).select("text", "lang"))
    return language.accepted(docs, model, least_score=0.3)


@_lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose word 5-gram sets are at least 80 % alike."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


@_lean
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that another document keeps."""
    return _counted(passages.remove(docs))


@_lean
def drop_benchmark_hits(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark windows from texts, and documents that are mostly made of them."""
    return _counted(decontamination.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@_lean
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all texts into sequences of 2048."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), limit=2048, end_id=0, words_kept=400_000, between_tasks=False)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("benchmark", drop_benchmark_hits),
    ("packing", pack_sequences),
]

#: SQL can neither fit the language model nor run the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over a folder's documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
