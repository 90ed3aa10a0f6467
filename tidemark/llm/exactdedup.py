"""Exact dedup with counting quotient filters.

1. One scan digests every document: length, SHA-256 and a 64-bit fingerprint of
   the text without ASCII white space.
2. Every partition of fingerprints becomes counting quotient filters, one a
   bucket (the top bits of a fingerprint). A filter holds, losslessly, the
   sorted remainders of each quotient with their counters; one bitmap marks the
   quotients in use, one the end of each run of remainders.
3. The filters of a bucket are merged by their sorted remainders. A hot
   fingerprint is one slot a partition, whatever the number of its copies.
4. Fingerprints counted more than once route their documents to the byte
   verification: a group-by on the text itself, which partial aggregation
   collapses to one row a task for every distinct text.
5. Each document looks its group up.

Defined cases: a null text is empty. A null ``doc_id`` loses to every other id
of equal texts; if all are null, ``keep_id`` is null and all of them are kept.
Rows that repeat a doc_id count one by one; those as long as the row that stays
are all marked kept. Columns other than ``doc_id`` and ``text`` are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import lookup
from tidemark.llm.scratch import materialize, partitions

U = np.uint64
SPACE = " \t\n\x0b\f\r"
_TOP, _FAR = 2**63 - 1, 10**20


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


# --- the filter ---------------------------------------------------------------


def _pack(values: np.ndarray, bits: int) -> bytes:
    width = max(1, -(-bits // 8))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    width = max(1, -(-bits // 8))
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return full.reshape(-1).view("<u8").astype(np.uint64)


def cqf_encode(values: np.ndarray, counts: np.ndarray, bits: int) -> dict:
    """A counting quotient filter of sorted distinct values below 2**bits."""
    n = len(values)
    qbits = min(bits, max(1, math.ceil(math.log2(max(2, n)))))
    rbits = bits - qbits
    quotient = values >> U(rbits)
    occupied = np.zeros(1 << qbits, bool)
    occupied[quotient] = True
    run_end = np.ones(n, bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    many = np.flatnonzero(counts > 1)
    return {
        "n": n,
        "qbits": qbits,
        "occupied": np.packbits(occupied).tobytes(),
        "run_end": np.packbits(run_end).tobytes(),
        "remainders": _pack(values & U((1 << rbits) - 1), rbits),
        "counted": many.astype("<u4").tobytes(),
        "counters": counts[many].astype("<u8").tobytes(),
    }


def cqf_decode(f: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values and their counts that ``cqf_encode`` was given."""
    n, qbits = f["n"], f["qbits"]
    used = np.flatnonzero(np.unpackbits(np.frombuffer(f["occupied"], np.uint8), count=1 << qbits))
    ends = np.unpackbits(np.frombuffer(f["run_end"], np.uint8), count=n)
    run = np.cumsum(ends) - ends
    values = (used[run].astype(np.uint64) << U(bits - qbits)) | _unpack(f["remainders"], n, bits - qbits)
    counts = np.ones(n, np.uint64)
    counts[np.frombuffer(f["counted"], "<u4")] = np.frombuffer(f["counters"], "<u8")
    return values, counts


def cqf_merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge decoded filters by their sorted remainders, adding counters."""
    values = np.concatenate([v for v, _ in filters])
    counts = np.concatenate([c for _, c in filters])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


_FILTER = pa.schema(
    [("bucket", pa.int32()), ("n", pa.int32()), ("qbits", pa.int32())]
    + [(k, pa.binary()) for k in ("occupied", "run_end", "remainders", "counted", "counters")]
)
_FILTER_DDL = "bucket int, n int, qbits int, occupied binary, run_end binary, remainders binary, counted binary, counters binary"


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of every fingerprint that occurs more than once in ``fps.fp``."""
    top = max(1, math.ceil(math.log2(partitions(fps.sparkSession))))
    low = 64 - top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.asarray(b.column(0)).astype(np.int64).view(np.uint64) for b in batches]
        got = [g for g in got if len(g)]
        if not got:
            return
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        cuts = np.flatnonzero(np.diff(values >> U(low))) + 1
        rows = []
        for v, c in zip(np.split(values, cuts), np.split(counts, cuts)):
            rows.append({"bucket": int(v[0] >> U(low)), **cqf_encode(v & U((1 << low) - 1), c, low)})
        yield pa.RecordBatch.from_pylist(rows, _FILTER)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        values, counts = cqf_merge([cqf_decode(f, low) for f in t.to_pylist()])
        keep = counts > 1
        whole = values[keep] | (U(key[0].as_py()) << U(low))
        return pa.table({"fp": whole.view(np.int64), "n": counts[keep].astype(np.int64)})

    filters = fps.select("fp").mapInArrow(build, _FILTER_DDL)
    return filters.groupBy("bucket").applyInArrow(merge, "fp long, n long")


# --- the operator ---------------------------------------------------------------


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col("text"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"),
        norm.alias("norm"),
    ).withColumn("fp", F.xxhash64("norm"))
    digests = materialize(
        base.select("doc_id", "n_chars", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")), "digest"
    )
    repeated = materialize(repeated_fingerprints(digests), "repeated")
    rank = F.col("n_chars").cast("decimal(10,0)") * F.lit(str(_FAR)).cast("decimal(21,0)") + (
        F.lit(_TOP).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    )
    groups = materialize(
        lookup(base, repeated, ["fp"], "n", "inner")
        .groupBy("fp", "norm")
        .agg(F.count("*").alias("group_size"), F.max(rank).alias("best"))
        .filter("group_size > 1")
        .select(
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            "group_size",
            (F.lit(_TOP).cast("decimal(20,0)") - F.col("best") % F.lit(str(_FAR)).cast("decimal(21,0)")).cast("long").alias("keep_id"),
            F.floor(F.col("best") / F.lit(str(_FAR)).cast("decimal(21,0)")).cast("long").alias("keep_chars"),
        ),
        "groups",
    )
    found = lookup(digests.drop("fp"), groups, ["sha"], "group_size")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("keep_id").isNull() | F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")), F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
