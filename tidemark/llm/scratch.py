"""Intermediate tables in the folder that all executors share.

Every operator that has to cut its lineage, or that reads an intermediate
result more than once, writes it as Parquet below ``spark.checkpoint.dir``.
The files outlive executors, so a lost executor costs a re-run of its tasks
and nothing else. The folder is read from the session; only a session without
one (tests, notebooks) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.ship import ship

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder of the session, made up only for a local master."""
    found = spark.conf.get(KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(KEY, made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a scan of the written files."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for each partition of a shuffle of whole texts; the most partitions.
SHARE, MOST = 32 << 20, 200_000


def width(df: DataFrame) -> int:
    """Partitions for a shuffle of the texts of ``df``: as many as the session says, or
    more if its files are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(partitions(df.sparkSession), min(MOST, sum(s for s in sizes if s < 1 << 60) // SHARE))


def partitions(spark: SparkSession) -> int:
    """Width of the session's shuffles; what follows may run Python on executors."""
    ship(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
