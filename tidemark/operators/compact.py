"""Planning and running compaction of a dataset's files.

Plans come from the manifest alone, by sorting, ``lead`` and limits on its rows;
one call makes one bounded change, whatever the size of the dataset.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import manifest as mf
from tidemark.operators.dataset import Dataset, Snapshot

MB = 1 << 20


@dataclass(frozen=True)
class Policy:
    """Sizes are of uncompressed data."""

    target: int = 128 * MB
    low: int = 100 * MB
    high: int = 140 * MB
    small: int = 64 * MB
    large: int = 196 * MB
    max_files: int = 2
    max_bytes: int = 280 * MB


@dataclass
class Plan:
    """What to do to which files."""

    kind: str
    reason: str
    files: list[str]
    n_bytes: int
    sort_column: str | None = None
    outputs: int = field(default=1)


def _sized(entries: DataFrame) -> DataFrame:
    return entries.select("file_path", F.col("uncompressed_size_in_bytes").alias("size"), "record_count", "min_values", "max_values")


def rows_per_part(n_bytes: int, rows: int, target: int) -> int:
    """Rows of an average size that fill ``target`` bytes; at least one."""
    return max(1, int(target / (n_bytes / rows))) if rows and n_bytes else 1


class Compactor:
    """Plans and runs one change at a time to the layout of a dataset.

    ``strategy`` is ``brute`` or ``performance`` (keeps files in ranges of the sort
    column); by default the latter if the dataset has a sort order.
    """

    def __init__(self, dataset: Dataset, strategy: str | None = None, author: str | None = None, agent: str | None = None, policy: Policy = Policy()):
        if strategy not in (None, "brute", "performance"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.dataset, self.policy = dataset, policy
        self.author, self.agent = author or dataset.doc.get("author") or "compactor", agent or "compactor"
        orders = dataset.doc.get("sort-orders") or []
        self.sort_column = self._column(orders[0]) if orders else None
        self.strategy = strategy or ("performance" if orders else "brute")
        self.decision = "user" if strategy else "auto" if orders else "no-sort"
        if self.strategy == "performance" and self.sort_column is None:
            self.strategy, self.decision = "brute", "no-sort"

    def _column(self, order) -> str | None:
        names = self.dataset.schema().names
        if isinstance(order, dict):
            order = order.get("column", order.get("id", order.get("name")))
        if isinstance(order, int):
            return names[order] if 0 <= order < len(names) else None
        return order if order in names else None

    # --- plans ---

    def plan(self, entries: DataFrame | None = None) -> Plan | None:
        """The next change, or None if the layout is fine."""
        rows = _sized(self.dataset.manifest(schema=self.dataset.schema()) if entries is None else entries)
        return self._performance(rows) if self.strategy == "performance" else self._brute(rows)

    def _split(self, rows: DataFrame) -> Plan | None:
        big = rows.filter(F.col("size") >= self.policy.large).orderBy("file_path").limit(1).collect()
        return Plan("split", "file-too-large", [big[0]["file_path"]], big[0]["size"]) if big else None

    def _brute(self, rows: DataFrame) -> Plan | None:
        if split := self._split(rows):
            return split
        p = self.policy
        small = rows.filter(F.col("size") < p.small).orderBy(F.desc("size"), "file_path").limit(max(2, p.max_files)).collect()
        if len(small) < 2:
            return None
        files, total = [], 0
        for r in small:
            if len(files) >= p.max_files or total >= p.low:
                break
            if total + r["size"] <= p.max_bytes:
                files.append(r["file_path"])
                total += r["size"]
        return Plan("combine", "small-files", files, total) if len(files) > 1 else None

    def _performance(self, rows: DataFrame) -> Plan | None:
        if split := self._split(rows):
            split.sort_column = self.sort_column
            return split
        i = self.dataset.schema().names.index(self.sort_column)
        ranged = rows.select("file_path", "size", F.get("min_values", F.lit(i)).alias("lo"), F.get("max_values", F.lit(i)).alias("hi")).filter("lo is not null")
        order = Window.orderBy("lo", "file_path")
        beside = ranged.select(
            "file_path", "size", "lo", "hi", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("file_path", "size", "lo")]
        )
        pairs = beside.filter((F.col("hi") >= F.col("next_lo")) & (F.col("size") + F.col("next_size") <= self.policy.max_bytes))
        hit = pairs.orderBy("lo", "file_path").limit(1).collect()
        if hit:
            r = hit[0]
            return Plan("combine-split", "overlapping-ranges", [r["file_path"], r["next_file_path"]], r["size"] + r["next_size"], self.sort_column)
        small = ranged.filter(F.col("size") < self.policy.small).orderBy("lo", "file_path").limit(2).collect()
        if len(small) == 2 and sum(r["size"] for r in small) <= self.policy.max_bytes:
            return Plan("combine-split", "small-files", [r["file_path"] for r in small], sum(r["size"] for r in small), self.sort_column)
        return self._brute(rows) if ranged.limit(1).count() == 0 else None

    # --- running ---

    def _parts(self, plan: Plan) -> int:
        return max(1, math.ceil(plan.n_bytes / self.policy.target)) if plan.kind == "split" or plan.n_bytes > self.policy.high else 1

    def compact(self, dry_run: bool = False) -> Plan | Snapshot | None:
        """Make the next change; with ``dry_run`` return its plan. None if there is none."""
        plan = self.plan()
        if plan is None:
            return None
        plan.outputs = self._parts(plan)
        if dry_run:
            return plan
        df = self.dataset.read(plan.files)
        if plan.sort_column:
            df = df.repartitionByRange(plan.outputs, plan.sort_column).sortWithinPartitions(plan.sort_column)
        else:
            df = df.coalesce(1) if plan.outputs == 1 else df.repartition(plan.outputs)
        agent = {"committer": self.agent, "strategy": self.strategy, "decision": self.decision, "kind": plan.kind, "reason": plan.reason}
        return self.dataset.replace_files(plan.files, df, self.author, f"compact by {self.agent}", agent, plan.n_bytes)

    def compact_all(self, limit: int | None = None) -> list[Snapshot]:
        """Make changes until none is left, or as many as ``limit``; ``plan`` tells what
        a limit left."""
        done: list[Snapshot] = []
        while (limit is None or len(done) < limit) and (s := self.compact()) is not None:
            done.append(s)
        return done

    def stats(self, entries: DataFrame | None = None) -> DataFrame:
        """One row: files, bytes and files of each size class."""
        p, size = self.policy, F.col("size")
        rows = _sized(self.dataset.manifest(schema=self.dataset.schema()) if entries is None else entries)
        return rows.agg(
            F.count("*").cast("long").alias("file_count"),
            F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"),
            F.count_if(size < p.small).cast("long").alias("small_file_count"),
            F.count_if(size >= p.large).cast("long").alias("large_file_count"),
            F.count_if((size >= p.low) & (size <= p.high)).cast("long").alias("acceptable_file_count"),
        )


def entries_of(spark, rows: list[dict]) -> DataFrame:
    """Manifest entries from dictionaries; what is missing is null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in mf.SCHEMA) for r in rows], mf.SCHEMA)


