"""The folder for intermediate and demonstration data that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; made up only for a local master."""
    found = spark.conf.get(KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(KEY, made)
    return made
