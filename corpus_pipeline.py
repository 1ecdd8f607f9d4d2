"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import decontaminate, frames, mixing, quality, simhash
from tallymart.session import fresh_path, tune


#: Documents below this probability of good quality are rejected.
QUALITY_THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that the classifier, learned from all labels of ``docs``, does not reject."""
    tune(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = frames.fresh(docs.columns, "score")
    kept = quality.with_score(docs, model, name=score).where(F.col(score) >= QUALITY_THRESHOLD)
    return kept.drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    tune(spark)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that hold no passage of a benchmark item."""
    tune(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for every epoch of its source it is in, with its place there."""
    tune(spark)
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

# No SQL: scores come from a trained model and fingerprints from XXH64, which DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, starting from the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
