"""Checking a manifest against the files that it describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import manifest as mf
from tidemark.operators.dataset import Dataset

FIELDS = ["nulls", "low", "high", "bytes", "bins", "hashes", "low_display", "high_display"]


def verify_manifest(dataset: Dataset, file_path: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(file_path, column, field, stored, recomputed) of each statistic that differs
    from a new measurement, of one file or all."""
    entries = dataset.manifest(schema=dataset.schema()) if stored is None else stored
    if file_path is not None:
        entries = entries.filter(F.col("file_path") == file_path)
    paths = [r[0] for r in entries.select("file_path").collect()]
    fresh = mf.file_statistics(dataset.spark, [p for p in paths if dataset.store.exists(p)], dataset.schema(), dataset.doc.get("properties", {}).get("sketch-hash", "xxhash64"))
    names = dataset.schema().names

    def long(df: DataFrame, value: str) -> DataFrame:
        rows = mf.per_column(df, names)
        every = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS], F.struct(F.lit("rows").alias("field"), F.col("record_count").cast("string").alias("value")))
        return rows.select("file_path", "column", F.explode(every).alias("s")).select("file_path", "column", "s.field", F.col("s.value").alias(value))

    both = long(entries, "stored").join(long(fresh, "recomputed"), ["file_path", "column", "field"], "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def column_bytes(dataset: Dataset) -> DataFrame:
    """(column, bytes): uncompressed bytes of each column by the manifest."""
    rows = mf.per_column(dataset.manifest(schema=dataset.schema()), dataset.schema().names)
    return rows.groupBy("column").agg(F.sum("bytes").cast("long").alias("bytes"))


def find_file(dataset: Dataset, file_path: str) -> DataFrame:
    """The entry of a file in the newest manifest that has it."""
    for s in reversed(dataset.snapshots()):
        found = dataset.entries(s).filter(F.col("file_path") == file_path)
        if s.manifest and found.limit(1).count():
            return found
    return mf.read_manifest(dataset.spark)


def entry_json(entries: DataFrame) -> DataFrame:
    """(file_path, entry): each entry as JSON."""
    return entries.select("file_path", F.to_json(F.struct(*entries.columns)).alias("entry"))
