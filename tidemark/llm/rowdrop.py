"""Dropping rows of documents by what an operator finds.

Each row of the input gets a number of its own, which the operator takes for its
id, and rows are dropped by that number. So rows without an id, and rows that share
one, are decided one by one.

Of a group the longest text stays (exact copies only), then the smallest id, a
null id after all others; rows that are still equal are told apart by a hash of
the text and their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import decontam, exactdedup, simhash
from tidemark.llm.joins import lookup
from tidemark.llm.scratch import materialize

ROW = "_row"


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a stored number each, and the same with it as their doc_id."""
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    return rows, rows.withColumn("doc_id", F.col(ROW))


def _rank(*first: Column) -> Column:
    ident = F.col("doc_id").cast("long")
    return F.struct(*first, ident.isNull(), ident, F.xxhash64("text"), F.col(ROW)).alias("rank")


def _losers(groups: DataFrame, rows: DataFrame, rank: Column) -> DataFrame:
    """The numbers in ``groups`` (_row, group) that aren't of the least rank of their group."""
    members = materialize(groups.join(rows.select(ROW, rank), ROW), "members")
    best = materialize(members.groupBy("group").agg(F.min("rank").alias("best"), F.count("*").alias("n")), "best")
    return lookup(members, best, ["group"], "n", "inner").filter("rank <> best").select(ROW)


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    gone = materialize(gone, "gone")
    small = gone.count() <= 1_000_000  # 8 MB of numbers
    return rows.join(F.broadcast(gone) if small else gone, ROW, "left_anti").select(*columns)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of each text without ASCII white space, with all columns."""
    rows, named = _numbered(docs)
    groups = exactdedup.exact_groups(named).filter("group_size > 1").select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group"))
    return _without(rows, _losers(groups, rows, _rank(-F.length(F.coalesce("text", F.lit(""))))), docs.columns)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns."""
    rows, named = _numbered(docs)
    groups = simhash.near_duplicates(named).filter("n_near > 0").select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    return _without(rows, _losers(groups, rows, _rank()), docs.columns)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows in which no window of an item occurs, with all columns."""
    rows, named = _numbered(docs)
    return _without(rows, decontam.contamination(named, items).filter("contaminated").select(F.col("doc_id").alias(ROW)), docs.columns)
