"""Labelled training rows and hashed features of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.scratch import materialize, partitions

#: Hashed features are places below 2**BITS.
BITS = 18
#: Bytes of the features of all training rows (4 a feature).
BYTES = 256 << 20

#: Features of consecutive documents: (document, place), distinct and sorted.
Features = Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; of a null id 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def distinct(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place) pairs, sorted."""
    both = tx.unique(doc.astype(np.int64) << BITS | place.astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


def per_text(texts: pa.Array, features: Features, score: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Apply ``score(n, doc, place)`` to the features of all texts."""
    out = np.zeros(len(texts))
    for first, n, doc, place in features(texts):
        out[first : first + n] = score(n, doc, place)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int, features: Features) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature places and 0/1 labels of at most ``rows`` labelled documents whose
    remainder is not ``out``: the labelled ids that come first by hash, fewer if their
    features would take over ``BYTES``. Null ids and labels are left out; of repeated
    labels the largest holds, of rows that share an id one."""
    partitions(docs.sparkSession)
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), folds) != out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[bytes] = [b""] * b.num_rows
            for first, n, doc, place in features(b.column(2)):
                cuts = np.searchsorted(doc, np.arange(n + 1))
                for i in range(n):
                    found[first + i] = place[cuts[i] : cuts[i + 1]].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "places"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    found = picked.select("doc_id", "label", "text").mapInArrow(gather, "doc_id long, label int, places binary")
    one = materialize(found.groupBy("doc_id", "label").agg(F.min("places").alias("places")), "features")
    sizes = one.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("places").alias("n")).toPandas().sort_values(["h", "doc_id"])
    fits = sizes["n"].cumsum() <= BYTES
    got = (one if fits.all() else one.join(F.broadcast(docs.sparkSession.createDataFrame(sizes[fits][["doc_id"]])), "doc_id", "left_semi")).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return [np.frombuffer(p, "<u4") for p in got["places"]], (got["label"].to_numpy() > 0).astype(np.int64)


def place_counts(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of the rows that have each place, some rows at a time."""
    out = np.zeros(1 << BITS)
    for lo in range(0, len(rows), 500):
        part = rows[lo : lo + 500]
        out += np.bincount(np.concatenate(part), np.repeat(weights[lo : lo + 500], [len(r) for r in part]), 1 << BITS)
    return out


def csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place of each feature."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _gram(data: np.ndarray, at: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Place of the ``k`` bytes from each position (k at most 8)."""
    code = np.full(len(at), salt, np.uint64)
    for j in range(k):
        code = code * np.uint64(0x100000001B3) + data[at + j].astype(np.uint64) + np.uint64(1)
    return tx.mix(code) >> np.uint64(64 - BITS)


def word_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lower-cased words with their first 4 and 5 and last 4 bytes, which words of
    one stem share."""
    for b in tx.blocks(texts, tx.ALNUM):
        data = tx.ALNUM[1][b.data]
        parts = [(b.doc, tx.word_hashes(b, tx.ALNUM) >> np.uint64(64 - BITS))]
        size = b.ends - b.starts
        for k in (4, 5):
            long = size >= k
            parts.append((b.doc[long], _gram(data, b.starts[long], k, k)))
        long = size >= 5
        parts.append((b.doc[long], _gram(data, b.ends[long] - 4, 4, 9)))
        yield b.first, b.n_docs, *distinct(np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts]))


def shape_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Byte 4-grams with their case, words, and how often a word repeats on the spot."""
    for b in tx.blocks(texts, tx.SPACED, 1 << 20):
        h = tx.word_hashes(b, tx.SPACED)
        parts = [(b.doc, h >> np.uint64(64 - BITS))]
        n = len(b.data) - 3
        if n > 0:
            doc = np.repeat(np.arange(b.n_docs), np.diff(b.offsets))
            inside = doc[:n] == doc[3:]
            parts.append((doc[:n][inside], _gram(b.data, np.flatnonzero(inside), 4, 1)))
        for k in (1, 2, 3):
            same = np.ones(max(0, len(h) - k), bool)
            for j in range(1, k + 1):
                same &= h[j : len(h) - k + j] == h[: len(h) - k]
            same &= b.doc[: len(h) - k] == b.doc[k:] if len(h) > k else True
            at = b.doc[: len(same)][same]
            parts.append((at, np.full(len(at), k, np.uint64)))
        yield b.first, b.n_docs, *distinct(np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts]))
