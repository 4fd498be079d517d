"""From raw documents to a tokenized corpus: toxicity, exact and near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; each result is
written as Parquet to the shared folder and read again. All stages but the last return the columns of
documents; the last returns a row of figures and digests for each document. Empty tables, nulls, repeated
rows and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lesionflow.llm import bpe, decontam, exact_dedup, neardup, toxicity
from lesionflow.plans.shared import stash


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more are dropped; the model learns from the labelled ones among ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return neardup.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item are dropped."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean_of_toxicity), ("exact_dedup", without_exact_copies), ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark), ("bpe", tokenized),
]
#: SQL cannot express the learnt and similarity stages; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
