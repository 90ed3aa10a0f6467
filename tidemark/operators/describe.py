"""Profiles of a dataset from the statistics of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as fc
from tidemark.functions import kmv
from tidemark.operators.manifest import BINS, per_column


def distribution(rows: DataFrame, bins: int) -> DataFrame:
    """(column, distribution): the values of all files in ``bins`` equal parts of the
    column's range. Each bin of a file counts at its midpoint; a file whose values
    are all the same, which has no histogram, counts at that value."""
    ranges = rows.groupBy("column").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    flat = F.array(F.struct(F.col("low").cast("double").alias("v"), (F.col("record_count") - F.col("nulls")).alias("c")))
    width = (F.col("high").cast("double") - F.col("low").cast("double")) / (BINS - 1)
    middle = lambda c, i: F.struct(
        F.least(F.col("low").cast("double") + (i.cast("double") + 0.5) * width, F.col("high").cast("double")).alias("v"), c.alias("c")
    )
    both = F.array(F.struct(F.lit(1.0).alias("v"), F.get("bins", F.lit(0)).alias("c")), F.struct(F.lit(0.0).alias("v"), F.get("bins", F.lit(1)).alias("c")))
    points = (
        F.when(F.col("low").isNull(), F.array().cast("array<struct<v:double,c:bigint>>"))
        .when(F.size("bins") == 2, both)
        .when(F.size("bins") > 0, F.transform("bins", middle))
        .otherwise(flat)
    )
    placed = rows.join(F.broadcast(ranges), "column").select("column", "lo", "hi", F.explode(points).alias("p"))
    span = F.col("hi").cast("double") - F.col("lo").cast("double")
    at = F.when(span == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("p.v") - F.col("lo").cast("double")) / span * bins))).cast("int")
    counted = placed.groupBy("column", at.alias("b")).agg(F.sum("p.c").alias("n"))
    filled = counted.groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    return filled.select(
        "column", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("long")).alias("distribution")
    )


def describe(manifest: DataFrame, schema: T.StructType, name: str, description: str | None, bins: int = 10) -> DataFrame:
    """One row a column: counts, range, cardinality and distribution."""
    names = [f.name for f in schema]
    if not names:
        raise ValueError(f"{name} has no schema")
    rows = per_column(manifest, names)
    sketches = kmv.merge(rows.select("column", F.col("hashes")), ["column"])
    merged = rows.groupBy("column").agg(
        F.sum("record_count").alias("row_count"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.sum(F.coalesce("nulls", F.lit(0))).alias("null_count"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("uncompressed_bytes"),
        F.min("low_display").alias("min_display"),
        F.max("high_display").alias("max_display"),
    )
    text = F.lit(False)
    sketched = F.lit(False)
    for f in schema:
        if fc.kind(f.dataType) == "string":
            text = text | (F.col("column") == f.name)
        if fc.kind(f.dataType) not in ("bool", "other"):
            sketched = sketched | (F.col("column") == f.name)

    order = F.array_position(F.array(*map(F.lit, names)), F.col("column"))
    return (
        merged.join(sketches, "column")
        .join(distribution(rows, bins), "column", "left")
        .select(
            F.lit(name).alias("dataset"),
            F.lit(description).cast("string").alias("description"),
            F.col("row_count").cast("long").alias("row_count"),
            "column",
            "min",
            "max",
            F.col("null_count").cast("long").alias("null_count"),
            F.col("uncompressed_bytes").cast("long").alias("uncompressed_bytes"),
            F.when(sketched, kmv.estimate(F.col("hashes"))).alias("cardinality"),
            F.when(sketched, kmv.is_exact(F.col("hashes"))).alias("cardinality_is_exact"),
            F.coalesce("distribution", F.array_repeat(F.lit(0).cast("long"), bins)).alias("distribution"),
            F.when(text, F.col("min_display")).alias("min_display"),
            F.when(text, F.col("max_display")).alias("max_display"),
            order.alias("_order"),
        )
        .orderBy("_order")
        .drop("_order")
    )
