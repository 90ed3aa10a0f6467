"""Mixing sources to target weights by systematic sampling.

Targets: the sources, in code point order with null last, weigh 5, 2, 1, 5, ...
and share 150 % of all words; a target stops at twice its source's size and the
excess is shared again by weight until no target is above that (water filling).

Sampling: each document of a source expects ``target / source_size`` copies. The
documents of a source are ranked by size, so that every stretch of sizes is hit
evenly, their expected copies are prefix-summed from one random offset a source,
and a document is emitted once for each integer boundary that its share crosses.
Sums are kept in integers of 2**-30 copies, modulo one copy, so they neither
overflow nor round at any length, and no document is taken over twice.

The ranks come from a range partitioning and the counts of each (source,
partition): a hot source spreads over many tasks, and no window spans one.

Defined cases: a null text has size 0; null is a source of its own; a source
without words has target 0 and none of its documents is taken; null ids sort
first among equal sizes; repeated rows are ranked one by one; an empty table
gives no rows. Only ``doc_id``, ``source`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.joins import lookup
from tidemark.llm.scratch import materialize, partitions

UNIT = 1 << 30
WEIGHTS = (5, 2, 1)
_SPACE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Materialised ``df`` with ``rank``, the row's place (from 0) within its
    ``group`` when sorted by ``order``; group columns must not be null."""
    keys = [*group, *order]
    n = partitions(df.sparkSession)
    spread = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialize(spread.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row for each partition in which a group occurs
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), f"{name}-runs")
    return lookup(placed.withColumn("_part", part), runs, [*group, "_part"], "_n", "inner").select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank")
    )


def targets(sizes: DataFrame, share: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """(skey, source_size, n_docs, target, step, offset) of each source."""
    sums = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = ranked(sums, [], ["skey"], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(placed.select("skey", "source_size", "n_docs", weight.cast("double").alias("weight")), "weights")
    cap = F.col("source_size") * F.lit(float(limit))
    total = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    all_words = float(share) * (total["s"] or 0)
    level, capped = all_words / total["w"] if total["w"] else 0.0, 0
    while total["w"]:  # few rounds: each one caps at least one more source
        over = F.lit(level) * F.col("weight") > cap
        now = sources.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, cap).otherwise(0.0)).alias("cap"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        if now["n"] == capped or not now["w"]:
            break
        capped, level = now["n"], (all_words - now["cap"]) / now["w"]
    share_of = F.lit(level) * F.col("weight")
    target = F.when(share_of > cap, cap).otherwise(share_of)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "skey")), 1, 7), 16, 10).cast("long") * 4
    return sources.withColumn("target", target).select(
        "skey",
        "source_size",
        "n_docs",
        "target",
        F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size") * UNIT)).cast("long").alias("step"),
        offset.alias("offset"),
    )


def mix_plan(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a document: doc_id, skey, size, source_size, target, copies, taken."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("skey"),
        n_words(F.col("text")).alias("size"),
    )
    placed = ranked(base, ["skey"], ["size", "doc_id"], "mix")
    goals = materialize(targets(placed, share, limit, weights), "targets")
    at = (F.col("offset") + F.col("rank") % UNIT * (F.col("step") % UNIT)) % UNIT
    copies = F.floor(F.shiftright(at + F.col("step"), 30)).cast("long")
    return lookup(placed, goals, ["skey"], "n_docs", "inner").select(
        "doc_id", "skey", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once for every copy that is taken,
    numbered from 0 in ``copy``, or in ``_copy`` or one with more underscores if there
    is such a column. Rows equal in id, source and size share one decision."""
    number = "copy"
    while number.lower() in {c.lower() for c in docs.columns}:
        number = "_" + number
    plan = mix_plan(docs, **how).filter("copies > 0").groupBy("doc_id", "skey", "size").agg(F.max("copies").alias("_copies"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("skey").alias("_skey"), F.col("size").alias("_size"), "_copies")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"))
    text, source, ident = (F.col("_row")[c] for c in ("text", "source", "doc_id"))
    same = F.col("_id").eqNullSafe(ident.cast("long")) & (F.col("_skey") == source_key(source)) & (F.col("_size") == n_words(text))
    return keyed.join(plan, same, "inner").select(
        *[F.col("_row")[c].alias(c) for c in docs.columns],
        F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)).alias(number),
    )
