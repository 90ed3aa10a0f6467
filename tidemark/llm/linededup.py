"""Fuzzy line dedup by MinHash.

1. The lines of all documents, normalised, meet by a hash and are compared: equal
   lines become one node, written once with its first occurrence.
2. A node's character shingles give a one-permutation MinHash signature of
   ``BANDS`` x ``ROWS`` bins; an empty bin borrows from one at
   random, the same for all lines. Lines of a Jaccard similarity of ``THRESHOLD`` share a band with a
   probability of ``1 - (1 - THRESHOLD ** ROWS) ** BANDS`` (0.996).
3. Band keys are exchanged as blobs of sorted keys, at most one entry a key and
   partition; only nodes that share a band go on, as (band, node) rows.
4. Nodes of a band are compared: all of a group of up to ``CROWD``; in a larger
   one each with its next neighbours on a ring, which joins what is alike. Then,
   in larger groups whose nodes are still of several components, those of
   different components are compared too. So no pair of a band that could join
   two components is left out, and a group of copies never makes all its pairs.
5. A pair is verified by the exact Jaccard similarity of its shingle sets.
6. Distributed union-find makes components; the first line of each stays, by
   (doc_id, line number).

Defined cases: a null text has no lines; blank lines are no lines and always stay;
a line of fewer characters than a shingle is one shingle; a null doc_id sorts last;
rows equal in id and text share one decision; other rows of one id are ordered by a
hash of their text; an empty table gives no rows. Other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import substring as sb
from tidemark.llm import text as tx
from tidemark.llm.components import components
from tidemark.llm.joins import lookup
from tidemark.llm.scratch import materialize, partitions

U = np.uint64
SHINGLE, BANDS, ROWS, THRESHOLD = 5, 24, 7, 0.8
CROWD, RING, SALTED = 4, 2, 100_000
#: Characters of the lines that are compared at once.
SPAN = 1 << 18
#: Bits of a band key that are kept: keys that agree in them cost a comparison. Entries
#: of a blob. Chunks for each partition of a shuffle.
KEY, PIECE, CHUNKS = 48, 1 << 18, 2
_LAST = 2**63 - 1
_STEP = U(0x9E3779B97F4A7C15)
_EMPTY = U(2**64 - 1)


def normal_lines(text: bytes) -> list[tuple[int, bytes]]:
    """(number, normalised line) of the lines that are not blank: ASCII letters
    lower-cased, white space at the ends cut."""
    return [(i, x) for i, x in enumerate(map(bytes.strip, text.lower().split(b"\n"))) if x]


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _probes(n: int) -> list[np.ndarray]:
    """Where an empty bin looks, try by try: bins at random, then every bin."""
    rng = np.random.default_rng(11)
    return [rng.integers(0, n, n) for _ in range(3 * n)] + [(np.arange(n) + k) % n for k in range(1, n)]


_PROBES = _probes(BANDS * ROWS)


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one of all lines, each filled up with zeros to a shingle, and
    how many places each line has."""
    long = np.array([len(x) for x in lines], np.int64)
    size = np.maximum(long, SHINGLE)
    points = np.frombuffer("".join(x.ljust(SHINGLE) for x in lines).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
    short = np.flatnonzero(long < SHINGLE)
    if len(short):
        place = (np.cumsum(size) - size)[short, None] + np.arange(SHINGLE)
        points[place[np.arange(SHINGLE) >= long[short, None]]] = 0
    return points, size


def _astride(size: np.ndarray) -> np.ndarray:
    """The places at which a shingle would reach into the next line."""
    return (np.cumsum(size)[:, None] - np.arange(1, SHINGLE)).reshape(-1)


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash signatures, one row of BANDS * ROWS bins a line."""
    n, bins = len(lines), BANDS * ROWS
    points, size = _points(lines)
    wide = points.astype(np.uint64)
    k = len(wide) - SHINGLE + 1
    h = wide[:k].copy()
    for i in range(1, SHINGLE):
        h *= _STEP
        h += wide[i : i + k]
    np.bitwise_xor(h, h >> U(32), out=h)
    h *= U(0xD6E8FEB86659FD93)
    np.bitwise_xor(h, h >> U(32), out=h)
    h *= U(0xC4CEB9FE1A85EC53)
    at = h >> U(40)
    at *= U(bins)
    at >>= U(24)
    at += np.repeat(np.arange(0, n * bins, bins, dtype=np.uint64), size)[:k]
    h &= U(2**40 - 1)
    astride = _astride(size)
    h[astride[astride < k]] = _EMPTY
    out = np.full(n * bins, _EMPTY)
    np.minimum.at(out, at.view(np.int64), h)
    out = out.reshape(n, bins)
    row, bin_ = np.nonzero(out == _EMPTY)
    full = out.copy()
    for probe in _PROBES:  # most are filled after one or two
        if not len(row):
            break
        lent = full[row, probe[bin_]]
        out[row, bin_] = lent
        open_ = lent == _EMPTY
        row, bin_ = row[open_], bin_[open_]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of each row."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(sig), 0) * U(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        key = tx.mix(key ^ parts[:, :, r]) + U(r)
    return tx.mix(key)


_LINES = "chunk int, lines binary"
_NODES = "node long, line string, doc_id long, rid long, number int"


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about 4 MB of text."""
    _, offsets = tx.buffers(b.column(2))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (4 << 20), "right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def _lines(n_chunks: int):
    """The lines of each batch, with the first place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole)):
            ids, rids = b.column(0).to_pylist(), b.column(1).to_pylist()
            raw, offsets = tx.buffers(b.column(2))
            first: dict[bytes, tuple] = {}
            for i in range(len(ids)):
                doc = _LAST if ids[i] is None else ids[i]
                for number, line in normal_lines(raw[offsets[i] : offsets[i + 1]].tobytes()):
                    old = first.get(line)
                    if old is None or (doc, rids[i], number) < old:
                        first[line] = (doc, rids[i], number)
            if first:
                texts = list(first)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
                chunk = ((h >> U(20)) % U(n_chunks)).astype(np.int64)
                order = np.argsort(chunk, kind="stable")
                values = list(first.values())
                lines = [texts[i] for i in order.tolist()]
                places = [np.array([values[i][k] for i in order.tolist()], np.int64) for k in range(3)]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk[order])) + 1, [len(h)]]).tolist()
                parts = [_put(h[order][i:j], [p[i:j] for p in places], lines[i:j]) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[order][cuts[:-1]], pa.int32()), pa.array(parts, pa.binary())], ["chunk", "lines"])

    return run


def _put(h: np.ndarray, places: list[np.ndarray], lines: list[bytes]) -> bytes:
    """Hashes, first places and texts of some lines, compressed."""
    numbers = np.stack([h.view(np.int64), *places, np.array([len(x) for x in lines], np.int64)])
    return zstandard.ZstdCompressor(level=1).compress(len(lines).to_bytes(8, "little") + numbers.tobytes() + b"".join(lines))


def _get(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    """What ``_put`` was given: rows of numbers, and the texts."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    numbers = np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n)
    ends = (8 + 40 * n + np.cumsum(numbers[4])).tolist()
    return numbers, [raw[i:j] for i, j in zip([8 + 40 * n, *ends], ends)]


def _keys(lines: list[str]) -> np.ndarray:
    """Band keys, made in blocks that bound the memory."""
    out, lo, size = [], 0, np.cumsum([len(x) + 40 for x in lines])
    while lo < len(lines):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 17), "right")))
        out.append(band_keys(signatures(lines[lo:hi])))
        lo = hi
    return np.concatenate(out) if out else np.zeros((0, BANDS), np.uint64)


def _make_nodes(key: tuple, t: pa.Table) -> pa.Table:
    """The distinct lines of a chunk, with their first place."""
    found = [_get(b) for b in t.column("lines").to_pylist()]
    numbers = np.concatenate([f[0] for f in found], axis=1)
    texts = [x for f in found for x in f[1]]
    h, doc, rid, number, _ = numbers
    order = np.lexsort((number, rid, doc, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    run, head = -1, set()
    begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    for i in np.flatnonzero(~new).tolist():  # of one hash: the same line, unless hashes collide
        if begin[i] != run:
            run, head = begin[i], {texts[order[begin[i]]]}
        new[i] = texts[order[i]] not in head
        head.add(texts[order[i]])
    keep = order[new]
    lines = [texts[i].decode("utf-8", "replace") for i in keep.tolist()]
    return pa.table(
        {
            "node": pa.array((np.int64(key[0].as_py()) << 32) + np.arange(len(keep))),
            "line": pa.array(lines, pa.string()),
            "doc_id": pa.array(doc[keep]),
            "rid": pa.array(rid[keep]),
            "number": pa.array(number[keep], pa.int32()),
        }
    )


def _put_nodes(nodes: np.ndarray) -> bytes:
    """Nodes as the place of their chunk in a list of the few chunks, and their number."""
    chunks, at = np.unique(nodes >> 32, return_inverse=True)
    low = nodes & 0xFFFFFFFF
    wide = [max(1, (int(x).bit_length() + 7) // 8) for x in (max(0, len(chunks) - 1), low.max(initial=0))]
    parts = [v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].tobytes() for v, k in zip((at, low), wide)]
    return bytes(wide) + len(chunks).to_bytes(8, "little") + len(nodes).to_bytes(8, "little") + chunks.astype("<i8").tobytes() + b"".join(parts)


def _get_nodes(blob: bytes) -> np.ndarray:
    k, n = (int.from_bytes(blob[i : i + 8], "little") for i in (2, 10))
    chunks, at, out = np.frombuffer(blob, "<i8", k, 18), 18 + 8 * k, []
    for width in blob[:2]:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        out.append(full.reshape(-1).view("<u8").astype(np.int64))
        at += n * width
    return (chunks[out[0]] << 32) + out[1]


_BLOBS = "bucket int, keys binary, nodes binary, marks binary"


def _send_bands(n_buckets: int):
    """For each bucket of keys: a partition's keys, whether several of its nodes have
    one, and the node that has it alone. Nodes of a key that is repeated within the
    partition are known to share it; they go to buckets below zero, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys = [], []
        for b in batches:
            keys.append(_keys(b.column(1).to_pylist()).reshape(-1) >> U(64 - KEY))
            nodes.append(np.repeat(np.asarray(b.column(0)).astype(np.int64), BANDS))
        if not nodes:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        rows: list[tuple] = []
        for b, part in sb._split(key[first] << U(64 - KEY), n_buckets):
            rows.append((b, sb.pack(key[first][part]), _put_nodes(node[first][part]), np.packbits(n[part] > 1).tobytes()))
        known = np.repeat(n > 1, n)
        for i, lo in enumerate(range(0, int(known.sum()), PIECE)):
            bucket = -1 - int(key[known][lo] % U(1 << 30)) - i
            rows.append((bucket, sb.pack(key[known][lo : lo + PIECE]), _put_nodes(node[known][lo : lo + PIECE]), b""))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "keys", "nodes", "marks"])

    return run


def _shared(key: tuple, t: pa.Table) -> pa.Table:
    """(band, node) of the nodes that share a band."""
    keys = [sb.unpack(b) for b in t.column("keys").to_pylist()]
    node = np.concatenate([_get_nodes(b) for b in t.column("nodes").to_pylist()])
    every = np.concatenate(keys)
    keep = np.ones(len(every), bool)
    if key[0].as_py() >= 0:
        marks = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(t.column("marks").to_pylist(), keys)])
        uniq, at, n = np.unique(every, return_inverse=True, return_counts=True)
        many = n > 1
        many[at[marks]] = True
        keep = many[at] & ~marks
    return pa.table({"band": pa.array(every[keep].view(np.int64)), "node": pa.array(node[keep])})


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """(line, code) of every shingle of every line. The codes are equal exactly where
    the shingles are; None if the lines have over 2**12 different characters."""
    points, size = _points(lines)
    if points.max() >= 1 << 12:
        known = np.zeros(0x110001, bool)
        known[points] = True
        if np.count_nonzero(known) > 1 << 12:
            return None
        points = (np.cumsum(known, dtype=np.uint32) - np.uint32(1))[points]
    wide = points.astype(np.uint64)
    k = len(wide) - SHINGLE + 1
    code = wide[:k].copy()
    for i in range(1, SHINGLE):
        code <<= U(12)
        code |= wide[i : i + k]
    inside = np.ones(len(wide), bool)
    inside[_astride(size)] = False
    return np.repeat(np.arange(len(lines)), size)[inside], code[inside[:k]]


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Sorted places of one of each (owner, code). All rows of a pair meet in one slot
    of a table; who holds it settles its equals, the others try another table."""
    size = 2 * np.bincount(owner, minlength=n).astype(np.uint64) + U(1)
    begin = np.cumsum(size) - size
    table = np.empty(int(size.sum()), np.int32)
    keep = np.zeros(len(code), bool)
    todo, mult = np.arange(len(code), dtype=np.int32), 0x9E3779B97F4A7C15
    while len(todo):
        mine, own = code[todo], owner[todo]
        slot = mine * U(mult)
        slot ^= slot >> U(32)
        slot *= U(0xD6E8FEB86659FD93)
        slot >>= U(32)
        slot *= size[own]
        slot >>= U(32)
        slot += begin[own]
        slot = slot.view(np.int64)
        table[slot] = todo
        won = table[slot]
        keep[won] = True
        todo = todo[code[won] != mine]
        mult = mult * 0xFF51AFD7ED558CCD % 2**64
    return np.flatnonzero(keep)


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., n[0] of them, then the same of the next."""
    ends = np.cumsum(n)
    return np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def alike(lines: list[str], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the shingle sets of lines ``a`` and ``b`` (places in ``lines``) have a
    Jaccard similarity of at least the threshold; exact, a sum over sets of codes."""
    coded = _codes(lines)
    if coded is None:
        sets = [shingles(x) for x in lines]
        return np.array([jaccard(sets[i], sets[j]) >= threshold for i, j in zip(a.tolist(), b.tolist())], bool)
    one = _distinct(*coded, len(lines))
    owner, code = coded[0][one], coded[1][one]
    n = np.bincount(owner, minlength=len(lines))
    begin = np.cumsum(n) - n
    out = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])  # no more can be shared
    a, b = a[out], b[out]
    if not len(a):
        return out
    pair = np.concatenate([np.repeat(np.arange(len(a)), n[a]), np.repeat(np.arange(len(a)), n[b])])
    both = code[np.concatenate([_runs(begin[a], n[a]), _runs(begin[b], n[b])])]
    union = np.bincount(pair[_distinct(pair, both, len(a))], minlength=len(a))
    out[out] = (n[a] + n[b] - union) / union >= threshold
    return out


def _similar(threshold: float):
    """The rows (a, b, x, y) whose lines x and y are similar; they come sorted by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            fresh = np.concatenate([[True], ids[1:] != ids[:-1]])  # the first pair of a line
            x, y = batch.column(2), batch.column(3).to_pylist()
            heads = np.flatnonzero(fresh)
            own = x.take(pa.array(heads)).to_pylist()
            head = np.cumsum(fresh) - 1
            cost = np.cumsum([len(t) for t in y]) + np.cumsum(np.where(fresh, pc.utf8_length(x), 0))
            good, lo = [], 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + SPAN, "right")))
                first = head[lo]
                lines = own[first : head[hi - 1] + 1]
                good.append(alike(lines + y[lo:hi], head[lo:hi] - first, len(lines) + np.arange(hi - lo), threshold))
                lo = hi
            if good:
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(good)))

    return run


def _group_pairs(bands: DataFrame) -> DataFrame:
    """(a, b) of the nodes that are compared first. Groups are walked in one order
    of the nodes, so that neighbours stay the same from band to band; those of over ``SALTED`` nodes in parts, whose heads are joined."""
    sizes = materialize(bands.groupBy("band").agg(F.count("*").alias("n")), "bands")
    sized = lookup(bands, sizes, ["band"], "n", "inner")
    salt = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / SALTED)).cast("long")
    sized = sized.withColumn("salt", salt).withColumn("place", F.xxhash64("node"))
    walk = Window.partitionBy("band", "salt").orderBy("place", "node")
    ahead = sized.select("node", "n", *[F.lead("node", j).over(walk).alias(f"g{j}") for j in range(1, CROWD)])
    near = F.array(*[F.when((F.col("n") <= CROWD) | (F.lit(j) <= RING), F.col(f"g{j}")) for j in range(1, CROWD)])
    beside = ahead.select("node", F.explode(near).alias("g")).filter("g is not null")
    heads = sized.filter(F.col("n") > SALTED).groupBy("band", "salt").agg(F.min("node").alias("node"))
    chain = heads.withColumn("g", F.lead("node").over(Window.partitionBy("band").orderBy("salt"))).select("node", "g").filter("g is not null")
    both = beside.unionByName(chain)
    return both.select(F.least("node", "g").alias("a"), F.greatest("node", "g").alias("b")).distinct()


class Lines:
    """The distinct lines of documents, written once, and what is asked of them."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD):
        n = partitions(docs.sparkSession)
        self.n_buckets, self.threshold = n, threshold
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
        lines = self.docs.select("doc_id", "rid", "text").mapInArrow(_lines(CHUNKS * n), _LINES)
        self.nodes = materialize(lines.groupBy("chunk").applyInArrow(_make_nodes, _NODES), "lines")

    def bands(self) -> DataFrame:
        """(band, node) of the lines that share a band with another."""
        sent = self.nodes.select("node", "line").mapInArrow(_send_bands(self.n_buckets), _BLOBS)
        return sent.groupBy("bucket").applyInArrow(_shared, "band long, node long")

    def texts(self, pairs: DataFrame) -> DataFrame:
        """(node, line) of the lines in ``pairs``; no others are moved."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialize(wanted, "line-wanted")
        small = wanted.count() <= 1_000_000  # 8 MB of numbers
        return materialize(self.nodes.select("node", "line").join(F.broadcast(wanted) if small else wanted, "node", "left_semi"), "line-texts")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        one = pairs.join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        both = one.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")).hint("merge"), "a")
        return both.select("a", "b", "x", "y").mapInArrow(_similar(self.threshold), "a long, b long")

    def parts(self) -> DataFrame:
        """(node, root) of the lines that have similar ones."""
        bands = materialize(self.bands(), "line-bands")
        pairs = materialize(_group_pairs(bands), "line-pairs")
        texts = self.texts(pairs)  # every node of a band has a neighbour, so these are all that can be asked for
        edges = materialize(self.verified(pairs, texts), "line-edges")
        found = materialize(components(edges), "line-parts")
        big = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "line-big")
        # what is still apart in a larger group: compare across components
        rooted = lookup(bands, big, ["band"], "n", "inner").join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        rooted = materialize(rooted, "line-rooted")
        mixed = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).filter("r0 <> r1")
        mixed = materialize(mixed.select("band", "n"), "line-mixed")
        if not mixed.count():
            return found
        rows = materialize(lookup(rooted, mixed, ["band"], "n", "inner").select("band", "node", "root"), "line-apart")
        x, y = rows.alias("x"), rows.alias("y")
        cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")))
        cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        more = self.verified(cross.join(pairs, ["a", "b"], "left_anti"), texts)  # those weren't similar
        return materialize(components(edges.unionByName(materialize(more, "line-edges"))), "line-parts")

    def kept(self) -> DataFrame:
        """(doc_id, rid, kept): the numbers of the lines that stay, for documents with any."""
        parts = self.parts()
        small = parts.count() <= 500_000  # 8 MB of pairs
        firsts = self.nodes.select("node", "doc_id", "rid", "number").join(F.broadcast(parts) if small else parts, "node", "left")
        alone = firsts.filter("root is null").select("doc_id", "rid", "number")
        one = firsts.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "rid", "number")).alias("p")).select("p.*")
        return alone.unionByName(one).groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list("number")).alias("kept"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, kept_lines (numbers from 0)."""
    lines = Lines(docs, threshold)
    kept = lines.kept()
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))).cast("long")
    key = F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id")
    counted = lines.docs.select(key, "rid", n.alias("n_lines"))
    joined = counted.join(kept, ["doc_id", "rid"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    return joined.select(
        F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.col("kept").alias("kept_lines")
    )


def remove_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with repeated lines taken out of ``text``; other columns as
    they are, blank lines and null texts too."""
    lines = Lines(docs, threshold)
    kept = lines.kept().select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), F.col("kept").alias("_kept"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    ident, text = F.col("_row")["doc_id"].cast("long"), F.col("_row")["text"].cast("string")
    same = (F.coalesce(ident, F.lit(_LAST)) == F.col("_id")) & (F.xxhash64(ident, text) == F.col("_rid"))
    joined = rows.join(kept, same, "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<int>")))
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.rlike(x, F.lit("[^ \\t-\\r]")) | F.array_contains("_kept", i))
    return joined.select(*[(F.array_join(left, "\n") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
