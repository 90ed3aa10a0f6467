"""Connected components by distributed union-find.

Every partition of the edges runs a union-find and keeps a spanning forest, so
an edge list shrinks to at most one edge a node and partition. Up to ``SINGLE``
edges that remain are finished by one task. More go through alternating large-
and small-star steps, each written to the shared folder, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import lookup
from tidemark.llm.scratch import materialize, partitions

#: Edges (16 bytes each) that one task may hold.
SINGLE = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[ia], root[ib]
        open_ = ra != rb
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> tuple[np.ndarray, np.ndarray]:
        a, c = ([nodes, *(h[0] for h in held)], [roots, *(h[1] for h in held)])
        return union_find(np.concatenate(a), np.concatenate(c))

    for b in batches:
        held.append(tuple(np.asarray(b.column(i)).astype(np.int64) for i in (0, 1)))
        if sum(len(h[0]) for h in held) >= max(1 << 16, len(nodes)):  # so that it is sorted a few times only
            nodes, roots = join()
            held = []
    if held:
        nodes, roots = join()
    if len(nodes):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "large")
    large = lookup(both, least, ["a"], "n", "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = materialize(large.filter("a <> b"), "edges")
    low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "small")
    small = lookup(large, low, ["a"], "n", "inner").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")


def components(edges: DataFrame, single: int = SINGLE) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long); root is the smallest
    node of the component. Loops and repeated edges do no harm."""
    partitions(edges.sparkSession)
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = materialize(edges.mapInArrow(_forest, "a long, b long"), "forest")
    if now.count() > single:
        now, before = now.filter("a <> b"), None
        while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()) != before:
            before, now = state, _stars(now)
        return now.unionByName(now.select(F.col("b").alias("a"), "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("root"))
    return now.coalesce(1).mapInArrow(_forest, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
