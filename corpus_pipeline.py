"""The corpus pipeline: stages over `documents`, each of which reads what the one before it kept.

All but the last return the columns of `documents`; `n_chars` follows the text. `run` writes what each stage returns to the
shared folder and reads it back, so that a lost executor costs one stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import decontaminate, jaccard, mixing, pii, quality
from moraine.llm.exchange import drop, saved, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too much with them."""
    return quality.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to the target weights; adds `copy`."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL can't express latent retrieval and bootstrapping; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), folder, name)
        if k:
            drop(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
