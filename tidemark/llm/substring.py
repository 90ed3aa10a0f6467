"""Repeated passages across documents, by level-wise doubling.

The lengths of the levels double up to ``window``: 7 and 13 words, or 7, 13, 25
and 50. Only what occurs in more than one document at one length is extended to
the next and counted again. The loop ends as soon as no candidates survive, or with
the level of ``window``: longer repeats cover no other words.

A level does not have to look at every window. One of the next length holds many of
this one; the one of the smallest hash stands for it, and two equal windows choose
the same. Of 7 words about a quarter of all positions are chosen.

A level is one exchange. Documents are put into chunks by hash, once; the
exchange is reused by every level. A chunk sends, for each bucket of the hash
space, one blob of its distinct hashes, sorted: a passage that a chunk holds ten
thousand times is one entry. A bucket answers each chunk with the hashes that
matter to it. So hot passages cost one entry a chunk, and nothing is broadcast.

Defined cases: a null text has no words. Of rows under one id none has the
smaller id; a null id is larger than any other. A text of fewer words than a
window has none. An empty table gives no rows. Only ``doc_id`` and ``text`` are
read. Candidates are found by a hash of 64 bits; what is removed is equal in
32 bits of a second, independent one as well, from other codes of every byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.scratch import materialize, width

U = np.uint64
WINDOW = 13
#: Up to this length no shorter level comes first.
SHORT = 12
#: Chunks and buckets for each partition of a shuffle.
CHUNKS, BUCKETS = 2, 1
_LAST = 2**63 - 1


# --- sorted hashes as blobs ------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 values as gaps: one byte of length each, then the bytes."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=U(0))
    octets = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    size = np.where(gaps == 0, 1, 8 - np.argmax(octets[:, ::-1] != 0, axis=1)).astype(np.uint8)
    codes = size - 1
    if len(codes) % 2:
        codes = np.append(codes, 0).astype(np.uint8)
    keep = np.arange(8) < size[:, None]
    return len(values).to_bytes(8, "little") + (codes[::2] | codes[1::2] << 4).astype(np.uint8).tobytes() + octets[keep].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The values that ``pack`` was given."""
    if not blob:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(blob[:8], "little")
    pairs = np.frombuffer(blob, np.uint8, -(-n // 2), 8)
    size = np.empty(2 * len(pairs), np.uint8)
    size[::2], size[1::2] = pairs & 15, pairs >> 4
    size = size[:n] + 1
    octets = np.zeros((n, 8), np.uint8)
    octets[np.arange(8) < size[:, None]] = np.frombuffer(blob, np.uint8, offset=8 + len(pairs))
    return np.cumsum(octets.view("<u8").reshape(-1), dtype=np.uint64)


def _split(values: np.ndarray, n_buckets: int):
    """(bucket, slice) of sorted hashes by their top bits."""
    tops = ((np.arange(1, n_buckets, dtype=object) << 64) // n_buckets).astype(np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(values, tops), [len(values)]])
    return [(b, slice(cuts[b], cuts[b + 1])) for b in range(n_buckets) if cuts[b + 1] > cuts[b]]


# --- words of a chunk -----------------------------------------------------------


class Chunk:
    """Word hashes of the documents of a chunk, in ascending order of id."""

    def __init__(self, t: pa.Table, checked: bool = False):
        t = t.set_column(t.schema.get_field_index("doc_id"), "doc_id", t.column("doc_id").fill_null(_LAST))
        t = t.sort_by("doc_id").combine_chunks()
        self.ids = np.asarray(t.column("doc_id")).astype(np.int64)
        texts = t.column("text")
        self.texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        hashes, others, counts = [], [], []
        for b in tx.blocks(self.texts, tx.SPACED):
            hashes.append(tx.word_hashes(b, tx.SPACED))
            if checked:
                others.append(tx.word_hashes(b, tx.SPACED, 1))
            counts.append(b.counts())
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.others = np.concatenate(others) if others else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words, and whether each is of one document."""
        h = tx.window_hashes(self.words, n)
        return h, self.doc[: len(h)] == self.doc[len(self.words) - len(h) :]

    def checks(self, n: int) -> np.ndarray:
        """The second hash of all runs of ``n`` words."""
        return (tx.window_hashes(self.others, n) >> U(32)).astype(np.uint32)

    def anchors(self, n: int, of: int) -> np.ndarray:
        """For each window of ``of`` words, the place of the run of ``n`` that stands for
        it (-1: not of one document)."""
        h, _ = self.windows(n)
        k = len(self.words) - of + 1
        if k <= 0:
            return np.zeros(0, np.int64)
        best, at = h[:k].copy(), np.arange(k)
        for i in range(1, of - n + 1):
            less = h[i : i + k] < best
            best[less] = h[i : i + k][less]
            at[less] = np.flatnonzero(less) + i
        at[self.doc[:k] != self.doc[of - 1 :]] = -1
        return at


def _bucketed(chunk: int, values: np.ndarray, marks: np.ndarray, ids: np.ndarray, checks: np.ndarray, n_buckets: int) -> pa.Table:
    parts = _split(values, n_buckets)
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in parts], pa.int32()),
            "chunk": pa.array([chunk] * len(parts), pa.int32()),
            "hashes": pa.array([pack(values[s]) for _, s in parts], pa.binary()),
            "marks": pa.array([np.packbits(marks[s]).tobytes() for _, s in parts], pa.binary()),
            "ids": pa.array([ids[s].astype("<i8").tobytes() for _, s in parts], pa.binary()),
            "checks": pa.array([checks[s].astype("<u4").tobytes() for _, s in parts], pa.binary()),
        }
    )


def _distinct(h: np.ndarray, ids: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (hash, check), whether several ids have each, the least id of
    each. Without checks the hash alone counts."""
    if not len(h):
        return h, np.zeros(0, bool), ids, checks
    order = np.lexsort((checks, h)) if len(checks) else np.argsort(h, kind="stable")  # within a chunk the ids ascend
    h, ids, checks = h[order], ids[order], checks[order] if len(checks) else checks
    cut = np.concatenate([[True], h[1:] != h[:-1]])
    if len(checks):
        cut[1:] |= checks[1:] != checks[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(h)) - 1
    return h[first], ids[first] != ids[last], ids[first], checks[first] if len(checks) else checks


_NO_IDS, _NO_CHECKS = np.zeros(0, np.int64), np.zeros(0, np.uint64)


def levels(window: int) -> list[int]:
    """The lengths that double up to ``window``."""
    out = [window]
    while out[0] > SHORT:
        out.insert(0, -(-out[0] // 2))
    return out


def _live(c: Chunk, lengths: list[int], k: int, known: np.ndarray) -> np.ndarray:
    """Places of the runs of ``lengths[k]`` words that are still candidates: in one
    document and, after the first level, with an anchor among the ``known``."""
    n = lengths[k]
    h, one = c.windows(n)
    if k == 0:
        return np.flatnonzero(one)
    before, _ = c.windows(lengths[k - 1])
    at = c.anchors(lengths[k - 1], n)
    good = np.flatnonzero(at >= 0)
    used = tx.unique(at[good])
    hit = np.zeros(len(before) + 1, bool)
    hit[used] = _member(before[used], known) >= 0
    return good[hit[at[good]]]


def _asked(lengths: list[int], k: int, n_buckets: int):
    """What a chunk asks at level ``k``: the runs that stand for a candidate of the next
    length; at the last level every candidate, with its check and least id."""
    last = k == len(lengths) - 1

    def ask(key: tuple, t: pa.Table, answers: pa.Table | None) -> pa.Table:
        c = Chunk(t, last)
        live = _live(c, lengths, k, _known(answers)[0] if answers is not None else _NO_CHECKS)
        h, _ = c.windows(lengths[k])
        if not last:
            at = c.anchors(lengths[k], lengths[k + 1])
            stands = np.zeros(len(h) + 1, bool)
            stands[at[at >= 0]] = True
            live = live[stands[live]]
        checks = c.checks(lengths[k])[live] if last else _NO_CHECKS
        found, several, least, checks = _distinct(h[live], c.ids[c.doc[live]], checks)
        return _bucketed(key[0].as_py(), found, several, least if last else _NO_IDS, checks, n_buckets)

    return ask


def _repeated(key: tuple, t: pa.Table) -> pa.Table:
    """Answer each chunk with its hashes that more than one document has."""
    hashes = [unpack(b) for b in t.column("hashes").to_pylist()]
    marks = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for m, h in zip(t.column("marks").to_pylist(), hashes)]
    every = np.concatenate(hashes)
    uniq, at, n = np.unique(every, return_inverse=True, return_counts=True)
    many = n > 1
    many[at[np.concatenate(marks)]] = True
    keep = many[at]
    out, lo = [], 0
    for h in hashes:
        out.append(pack(h[keep[lo : lo + len(h)]]))
        lo += len(h)
    none = pa.array([b""] * len(out), pa.binary())
    return pa.table({"chunk": t.column("chunk"), "hashes": pa.array(out, pa.binary()), "ids": none, "checks": none})


def _known(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, their ids and checks of all answers to a chunk."""
    if not t.num_rows:
        return _NO_CHECKS, _NO_IDS, _NO_CHECKS
    h = np.concatenate([unpack(b) for b in t.column("hashes").to_pylist()])
    ids = np.concatenate([np.frombuffer(b, "<i8") for b in t.column("ids").to_pylist()])
    checks = np.concatenate([np.frombuffer(b, "<u4") for b in t.column("checks").to_pylist()])
    order = np.argsort(h, kind="stable")
    return h[order], ids[order] if len(ids) else ids, checks[order] if len(checks) else checks


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``known``, -1 where it is not there."""
    if not len(known) or not len(h):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    at[known[at] != h] = -1
    return at


def _least(key: tuple, t: pa.Table) -> pa.Table:
    """Answer each chunk with the least id of its windows, where a document of the chunk can have a larger one."""
    hashes = [unpack(b) for b in t.column("hashes").to_pylist()]
    ids, checks = (np.concatenate([np.frombuffer(b, kind) for b in t.column(c).to_pylist()]) for c, kind in (("ids", "<i8"), ("checks", "<u4")))
    marks = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for m, h in zip(t.column("marks").to_pylist(), hashes)])
    every = np.concatenate(hashes)
    order = np.lexsort((checks, every))
    cut = np.flatnonzero(np.concatenate([[True], (every[order][1:] != every[order][:-1]) | (checks[order][1:] != checks[order][:-1])]))
    group = np.empty(len(every), np.int64)
    group[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(every))))
    found = np.minimum.reduceat(ids[order], cut)[group]
    keep = (found < ids) | marks
    out, own, seconds, lo = [], [], [], 0
    for h in hashes:
        part = slice(lo, lo + len(h))
        out.append(pack(h[keep[part]]))
        own.append(found[part][keep[part]].astype("<i8").tobytes())
        seconds.append(checks[part][keep[part]].astype("<u4").tobytes())
        lo += len(h)
    kinds = {"hashes": out, "ids": own, "checks": seconds}
    return pa.table({"chunk": t.column("chunk"), **{k: pa.array(v, pa.binary()) for k, v in kinds.items()}})


def _remove(window: int, with_text: bool):
    def run(key: tuple, t: pa.Table, answers: pa.Table | None) -> pa.Table:
        c = Chunk(t, True)
        known, least, checks = _known(answers) if answers is not None else (_NO_CHECKS, _NO_IDS, _NO_CHECKS)
        h, one = c.windows(window)
        at = _member(h, known)
        at[~one] = -1
        places, second, hit = np.flatnonzero(at >= 0), c.checks(window), []
        while len(places):  # the next of the same hash, where the check is another
            same = checks[at[places]] == second[places]
            hit.append(places[same & (least[at[places]] < c.ids[c.doc[places]])])
            places = places[~same]
            at[places] += 1
            places = places[at[places] < len(known)]
            places = places[known[at[places]] == h[places]]
        hit = np.concatenate([np.zeros(0, np.int64), *hit])
        edge = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(c.doc[gone], minlength=len(c.ids))
        raw, offsets = tx.buffers(c.texts)
        sha, kept_text = [], []
        for i in range(len(c.ids)):
            words = raw[offsets[i] : offsets[i + 1]].tobytes().split()
            if removed[i]:
                lost = gone[c.begin[i] : c.begin[i] + c.counts[i]]
                words = [words[k] for k in np.flatnonzero(~lost)]
            kept = b" ".join(words)
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode())
        columns = {
            "doc_id": pa.array(c.ids, mask=c.ids == _LAST),
            "n_words": pa.array(c.counts.astype(np.int64)),
            "n_removed": pa.array(removed.astype(np.int64)),
            "kept_sha256": pa.array(sha, pa.string()),
        }
        return pa.table(columns | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {}))

    return run


def _each(chunks: GroupedData, answers: DataFrame | None, run, schema: str) -> DataFrame:
    """``run(key, chunk, its answers)`` of each chunk."""
    if answers is None:
        return chunks.applyInArrow(lambda key, t: run(key, t, None), schema)
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256; with
    ``with_text`` also ``kept_text``, the kept words joined by one space."""
    n = width(docs)
    n_chunks, n_buckets = CHUNKS * n, BUCKETS * n
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row that is repeated, or empty, is not one chunk: rows of other partitions go elsewhere
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_chunks)).cast("int")).repartition(n, "chunk")
    by_chunk = base.groupBy("chunk")
    sent, told = "bucket int, chunk int, hashes binary, marks binary, ids binary, checks binary", "chunk int, hashes binary, ids binary, checks binary"
    lengths, answers = levels(window), None
    for k in range(len(lengths)):
        ask = _asked(lengths, k, n_buckets)
        asked = _each(by_chunk, answers, ask, sent)
        answers = asked.groupBy("bucket").applyInArrow(_least if k == len(lengths) - 1 else _repeated, told)
        if len(lengths) > 2 and k < len(lengths) - 1:  # else the levels are one job
            answers = materialize(answers, "repeats").filter(F.octet_length("hashes") > 0)
            if answers.isEmpty():
                answers = None
                break
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return _each(by_chunk, answers, _remove(window, with_text), out)
