"""Near-duplicate documents by SimHash and pigeonhole blocks.

A fingerprint has 64 bits. Cut into ``b`` blocks, two fingerprints that differ
in at most 3 bits agree on at least ``b - 3`` whole blocks; each choice of that
many blocks is a table, keyed by the chosen bits. ``b`` grows with the number
of distinct fingerprints, so that a key stays longer than their logarithm. Rows
that share a key are joined and verified by their Hamming distance; a pair counts
in the first table that finds it. A key that over ``CROWD`` fingerprints share is
refined by blocks of its other bits in the same way, which loses no pair.

Documents of one fingerprint are one node with a count; they are never paired.

Defined cases: a null or empty text has fingerprint 0 and is linked like any
other; rows that repeat a doc_id are documents of their own; a null doc_id is
counted but never names a component unless no id is in it; an empty table gives
no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.components import components
from tidemark.llm.joins import lookup
from tidemark.llm.scratch import materialize, partitions

DISTANCE, SHINGLE, SEED, CROWD = 3, 3, 42, 1024

#: For each byte, its bits as counters of 8 bits in one word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(256)


def _shingles(words: list[bytes]):
    if len(words) < SHINGLE:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that over half of each run of hashes have set; run lengths in ``counts``."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begin = np.cumsum(n) - n
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(begin - first * 255, pieces) + np.arange(pieces.sum()) * 255
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(some), 64), np.uint8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        bits[:, 8 * j : 8 * j + 8] = 2 * sums > n[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text."""
    words = [t.lower().split() for t in texts]
    counts = np.array([max(len(w) - SHINGLE + 1, min(len(w), 1)) for w in words], np.int64)
    total = int(counts.sum())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(map(_shingles, words)), repeat(SEED)), np.uint64, total)
    return majority(hashes, counts)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tx.buffers(batch.column(1))
        found, lo = [], 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
            hi = min(hi, len(offsets) - 1)
            found.append(fingerprints([raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]))
            lo = hi
        fps = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    partitions(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def block_masks(bits: list[int], b: int) -> list[int]:
    """A mask for each choice of ``b - DISTANCE`` of ``b`` blocks of the bits."""
    parts = [sum(1 << k for k in bits[i * len(bits) // b : (i + 1) * len(bits) // b]) for i in range(b)]
    return [_signed(sum(c)) for c in combinations(parts, b - DISTANCE)]


def _first(x: Column, masks: list[int]) -> Column:
    """Index of the first table that agrees where ``x`` has no bit."""
    return F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])


def _paired(rows: DataFrame, on: list[str]) -> DataFrame:
    a, b = rows.alias("a"), rows.withColumnRenamed("fp", "fp2").alias("b")
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    return a.join(b, on).filter((F.col("fp") < F.col("fp2")) & (F.bit_count(x) <= DISTANCE)).withColumn("x", x)


def near_pairs(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: the pairs of the distinct ``fps.fp`` at distance 1 to 3."""
    n = max(1, fps.count())
    b = next((b for b in range(4, 8) if n <= 2 ** (64 * (b - DISTANCE) // b - 3)), 8)
    masks = block_masks(list(range(64)), b)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    crowds = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd), "crowds")
    usual = rows
    crowded = crowds.count() > 0
    if crowded:
        marked = lookup(rows, crowds, ["t", "key"], "n")
        usual = marked.filter("n is null").drop("n")
    pairs = _paired(usual, ["t", "key"]).filter(F.col("t") == _first(F.col("x"), masks)).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    if not crowded:
        return pairs
    finer = F.array(*[F.array(*map(F.lit, block_masks([k for k in range(64) if not (m >> k) & 1], 8))) for m in masks])
    deep = marked.filter("n is not null").select("t", "key", "fp", F.posexplode(F.element_at(finer, F.col("t") + 1)).alias("u", "mask"))
    deep = deep.select("t", "key", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"), "fp")
    more = _paired(deep, ["t", "key", "u", "key2"]).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    return pairs.unionByName(more).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fingerprint, n_near, component_id."""
    prints = materialize(document_fingerprints(docs), "simhash")
    fps = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "fps")
    pairs = materialize(near_pairs(fps), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(fps.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("near"))
    parts = materialize(components(pairs), "parts")
    named = parts.join(fps.select(F.col("fp").alias("node"), "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("size"))
    linked = lookup(parts, materialize(least, "least"), ["root"], "size", "inner").select(F.col("node").alias("fp"), "component")
    linked = linked.join(near.withColumnRenamed("a", "fp"), "fp")
    info = materialize(
        fps.join(linked, "fp", "left").select(
            "fp", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.coalesce("component", "least").alias("component_id")
        ),
        "info",
    )
    return lookup(prints, info, ["fp"], "n", "inner").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id"
    )
