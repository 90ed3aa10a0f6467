"""Benchmark decontamination with a positional inverted index.

The corpus is indexed in segments of some megabytes of text, each of which is a
row of the stored index: its documents, its distinct terms with their
frequencies, and the compressed positions of each term. Building needs no
shuffle, and an index serves any number of test sets.

A search reads the segments once for each block of test items, whose windows go
to every task (a block is bounded). In a segment, a window is looked up from its
rarest term: the positions of that term, less its offset in the window, are the
candidates; they are intersected with the offset-adjusted positions of the other
terms, by rising frequency. All windows are intersected together. With ``slop``,
a window matches at a start if each of its words is in the document at most so many
places off its own; with 0 the match is the exact phrase. The words of a match are
those from its start on that are in the document.

Defined cases: a null text has no words; rows that repeat a doc_id, and rows
without one, are documents of their own; an item without words matches nothing;
one of fewer words than a window is one window; the id of an item is compared as
a string, a null id as ``null``; items of one id count as one. With no documents
there are no rows, with no items nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.mixing import ranked
from tidemark.llm.scratch import materialize, partitions

WINDOW = 10
#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT = 4 << 20
#: Test items, and bytes of their texts, whose windows a task holds at once (on average,
#: where there are several blocks; an item is never split).
ITEMS, ITEM_BYTES = 20_000, 4 << 20

INDEX = "segment long, doc_ids array<long>, lengths binary, terms binary, frequencies binary, positions binary"
_HITS = "segment long, doc int, doc_id long, n_words long, items array<string>, starts array<int>, ends array<int>"
_HITS_ARROW = pa.schema(
    [("segment", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64())]
    + [("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
)


def _encode(positions: np.ndarray) -> bytes:
    gaps = np.diff(positions.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _decode(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    gaps = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.uint32)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs``, one row a segment; write it to keep it."""
    partitions(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            raw, offsets = tx.buffers(batch.column(1))
            lo = 0
            while lo < len(offsets) - 1:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, "right")) - 1)
                hi = min(hi, len(offsets) - 1)
                hashes, counts = [], []
                for b in tx.blocks(batch.column(1).slice(lo, hi - lo), tx.ALNUM):
                    hashes.append(tx.word_hashes(b, tx.ALNUM))
                    counts.append(b.counts())
                words = np.concatenate(hashes)
                order = np.argsort(words, kind="stable")
                ordered = words[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(words) else np.zeros(0, np.int64)
                row = {
                    "segment": [serial],
                    "doc_ids": [batch.column(0).slice(lo, hi - lo).to_pylist()],
                    "lengths": [np.concatenate(counts).astype("<i4").tobytes()],
                    "terms": [ordered[first].astype("<u8").tobytes()],
                    "frequencies": [np.diff(np.append(first, len(words))).astype("<i4").tobytes()],
                    "positions": [_encode(order)],
                }
                kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))
                serial += 1
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX)


class Windows:
    """The windows of some test items, as places in a sorted list of terms."""

    def __init__(self, texts: list[str | None], ids: list[str], window: int):
        found, item = [], []
        serial = 0
        for b in tx.blocks(pa.array([t or "" for t in texts], pa.string()), tx.ALNUM):
            h, counts = tx.word_hashes(b, tx.ALNUM), b.counts()
            begin = np.cumsum(counts) - counts
            for n, lo in zip(counts.tolist(), begin.tolist()):
                for k in range(lo, lo + max(min(n, 1), n - window + 1)):
                    found.append(h[k : k + min(n, window)])
                    item.append(serial)
                serial += 1
        self.ids, self.item = ids, np.array(item, np.int64)
        self.size = np.array([len(w) for w in found], np.int64)
        self.terms = tx.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.places = np.full((len(found), window), -1, np.int64)
        if found:
            inside = np.arange(window) < self.size[:, None]
            self.places[inside] = np.searchsorted(self.terms, np.concatenate(found))


def search_segment(w: Windows, terms, frequencies, positions, lengths, slop: int = 0):
    """(window, document, start, end) of the matches in a segment; the words are
    numbered through all documents."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(w.terms) or not len(terms):
        return none
    at = np.minimum(np.searchsorted(terms, w.terms), len(terms) - 1)
    n = np.where(terms[at] == w.terms, frequencies[at], 0).astype(np.int64)
    df = np.where(w.places >= 0, n[w.places], np.iinfo(np.int64).max)
    live = np.flatnonzero(df.min(axis=1) > 0)
    if not len(live):
        return none
    begin = np.cumsum(frequencies, dtype=np.int64) - frequencies

    def expand(starts, counts):
        ends = np.cumsum(counts)
        return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)

    # positions of the test terms here, sorted by (term, position)
    lists = np.repeat(np.arange(len(n)), n) << 32 | positions[expand(begin[at], n)].astype(np.int64)
    head = np.cumsum(n) - n
    order = np.argsort(df[live], axis=1, kind="stable")
    rare = order[:, 0]
    term = w.places[live, rare]
    which = np.repeat(np.arange(len(live)), n[term])
    anchor = lists[expand(head[term], n[term])] & 0xFFFFFFFF
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, anchor, "right")
    which, doc, start = (np.repeat(v, 2 * slop + 1) for v in (which, doc, anchor - rare[which]))
    start += np.tile(np.arange(-slop, slop + 1), len(anchor))  # wherever the rarest term may stand
    first, stop = (ends - lengths)[doc], ends[doc]
    for k in range(1, w.places.shape[1]):
        if not len(which):
            return none
        col = order[which, k]
        term = w.places[live[which], col]
        lo, hi = np.maximum(start + col - slop, first), np.minimum(start + col + slop, stop - 1)
        found = lists[np.minimum(np.searchsorted(lists, term << 32 | np.clip(lo, 0, None)), len(lists) - 1)]
        ok = (term < 0) | ((lo <= hi) & (found >= (term << 32 | lo)) & (found <= (term << 32 | np.clip(hi, 0, None))))
        which, doc, start, first, stop = which[ok], doc[ok], start[ok], first[ok], stop[ok]
    window = live[which]
    low, high = np.maximum(start, first), np.minimum(start + w.size[window], stop)
    ok = low < high
    return window[ok], doc[ok], low[ok], high[ok]


def _search(w: Windows, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("terms", "frequencies", "positions", "lengths")}
                lengths = np.frombuffer(row["lengths"].as_py(), "<i4").astype(np.int64)
                terms = np.frombuffer(row["terms"].as_py(), "<u8")
                frequencies = np.frombuffer(row["frequencies"].as_py(), "<i4").astype(np.int64)
                window, doc, start, end = search_segment(w, terms, frequencies, _decode(row["positions"].as_py()), lengths, slop)
                begin = (np.cumsum(lengths) - lengths)[doc] if len(doc) else 0
                items: list[list[str]] = [[] for _ in lengths]
                starts: list[list[int]] = [[] for _ in lengths]
                stops: list[list[int]] = [[] for _ in lengths]
                for d, x in np.unique(np.stack([doc, w.item[window]]), axis=1).T.tolist() if len(doc) else ():
                    items[d].append(w.ids[x])
                order = np.argsort(start, kind="stable")
                for d, a, b in zip(doc[order].tolist(), (start - begin)[order].tolist(), (end - begin)[order].tolist()):
                    if stops[d] and a <= stops[d][-1]:
                        stops[d][-1] = max(stops[d][-1], b)
                    else:
                        starts[d].append(a)
                        stops[d].append(b)
                n = len(lengths)
                columns = [[batch.column("segment")[i].as_py()] * n, range(n), batch.column("doc_ids")[i].as_py(), lengths.tolist(), items, starts, stops]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _HITS_ARROW)], schema=_HITS_ARROW)

    return run


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block: int = ITEMS, stored: bool = False) -> DataFrame:
    """One row an indexed document: segment, doc, doc_id, n_words, items (ids of
    the items with a matching window, sorted), spans (words, end exclusive). An
    index that isn't ``stored`` is written first if several blocks have to read it."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(-(-found["n"] // block), -(-found["bytes"] // ITEM_BYTES))
    parts = [items]
    if n_blocks > 1:
        placed = materialize(ranked(items, [], ["item_id", "text"], "items"), "items")
        index = index if stored else materialize(index, "postings")
        parts = [placed.filter(F.col("rank") % n_blocks == k) for k in range(n_blocks)]
    hits = None
    for part in parts:
        got = part.select("item_id", "text").toPandas()
        found = index.mapInArrow(_search(Windows(got["text"].tolist(), got["item_id"].tolist(), window), slop), _HITS)
        hits = found if hits is None else hits.unionByName(found)
    if len(parts) > 1:
        every = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one row a block of items
        hits = hits.groupBy("segment", "doc", "n_words").agg(F.first("doc_id").alias("doc_id"), every("items"), every("starts"), every("ends"))
    spans = F.array_sort(F.transform(F.arrays_zip("starts", "ends"), lambda z: F.struct(z["starts"].alias("start"), z["ends"].alias("end"))))
    return hits.select("segment", "doc", "doc_id", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), spans.alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items, contaminated."""
    hits = search(materialize(build_index(docs), "postings"), items, window, slop, stored=True)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")
        ),
        lambda s: s["n"],
    )
    return hits.withColumn("n_hit", F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(covered)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )
