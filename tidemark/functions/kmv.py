"""Distinct counts from the 32 smallest hashes (KMV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hash64, unsigned

K = 32
_RANGE = float(2**64)


def estimate(hashes: Column) -> Column:
    """Distinct values behind a sketch: exact below K hashes, else (k-1) 2^64 / (max+1)."""
    top = F.array_max(hashes).cast("double")
    return F.when(F.size(hashes) < K, F.size(hashes).cast("long")).otherwise(F.floor(F.lit(float(K - 1)) * _RANGE / (top + 1.0)).cast("long"))


def is_exact(hashes: Column) -> Column:
    return F.size(hashes) < K


def sketch(df: DataFrame, column: str, by: list[str] | None = None, method: str = "xxhash64") -> DataFrame:
    """(by..., hashes): the K smallest distinct hashes of a column. Distinct values
    are reduced by partial aggregation; a ranking by group keeps K of them."""
    from pyspark.sql import Window

    by = by or []
    h = unsigned(hash64(F.col(column), df.schema[column].dataType, method))
    seen = df.select(*by, h.alias("h")).filter("h is not null").distinct()
    if by:
        seen = seen.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("_r") <= K)
    else:
        seen = seen.orderBy("h").limit(K)
    return seen.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("hashes"))


def merge(sketches: DataFrame, by: list[str] | None = None, column: str = "hashes") -> DataFrame:
    """Union of sketches: the K smallest hashes among theirs."""
    return sketches.groupBy(*(by or [])).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, K).alias("hashes"))
