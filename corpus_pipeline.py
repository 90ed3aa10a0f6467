"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it
keeps, with their columns; the last returns the mixed corpus, each document once
for every copy taken and numbered in ``copy``. Stages handle empty tables and null
texts as their operators state; rows are dropped one by one, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, quality, rowdrop
from tidemark.llm.scratch import materialize


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rowdrop.exact_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rowdrop.drop_near_duplicates(docs)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rowdrop.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", _quality),
    ("exact_dedup", _exact),
    ("simhash_near_dedup", _near),
    ("decontamination", _clean),
    ("mixing", _mixed),
]

#: The quality model and the fingerprints have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
