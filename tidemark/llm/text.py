"""Vectorised tokenising and hashing of Arrow string columns.

The whole-corpus text operators need word boundaries, word hashes and window
hashes of every document. They are computed here with numpy over the bytes of
an Arrow batch, without a Python object per word.

A hash of a word is a sum of random 64-bit codes of its bytes, weighted by
powers of an odd constant modulo 2**64; prefix sums give it for all words of a
block at once. A window hash is the same sum over word hashes. Both end in a
finaliser that spreads every bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
BLOCK = 1 << 21


def _tables(word, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.array([word(b) for b in range(256)])
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return is_word[fold], fold


#: Words between ASCII white space, unchanged.
SPACED = _tables(lambda b: not (b == 0x20 or 9 <= b <= 13), False)
#: Lower-cased words of digits, a-z and every character beyond ASCII.
ALNUM = _tables(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, True)

_codes = np.random.default_rng(20240229).integers(0, 2**64, (2, 256), dtype=np.uint64)


def unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which beats the hash table of ``np.unique``."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(32)
    return h


@lru_cache(maxsize=8)
def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(base), run(pow(base, -1, 2**64))


def powers(base, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    up, down = _power_table(int(base), size)
    return up[:n], down[:n]


@dataclass
class Block:
    """Some consecutive documents of a batch and their words.

    ``offsets`` bound the documents in ``data``; ``first`` is the index of the
    first in the batch. ``starts`` and ``ends`` bound the words, ``doc`` is the
    block's index of the document of each.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        """Words of each document."""
        return np.bincount(self.doc, minlength=self.n_docs)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(texts: pa.Array, tables, size: int = BLOCK) -> Iterator[Block]:
    """Split documents into blocks of about ``size`` bytes and find their words.
    A longer document is a block of its own; none is cut."""
    is_word, _ = tables
    raw, offsets = buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        base = offsets[first]
        data = raw[base : offsets[last]]
        own = offsets[first : last + 1] - base
        m = is_word[data]
        before = np.zeros(len(m) + 1, bool)  # whether a word of the same document goes on from the left
        before[1:] = m
        before[own] = False
        starts = np.flatnonzero(m & ~before[:-1])
        after = np.zeros(len(m) + 1, bool)  # whether it goes on to the right
        after[: len(m)] = m
        after[own] = False
        ends = np.flatnonzero(m & ~after[1:]) + 1
        doc = np.searchsorted(own, starts, "right") - 1
        yield Block(first, data, own, starts, ends, doc)
        first = last


def word_hashes(b: Block, tables, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of a block; ``which`` (0, 1) gives two that are
    independent of each other."""
    if not len(b.starts):
        return np.zeros(0, np.uint64)
    _, fold = tables
    up, down = powers(_BASE, len(b.data) + 1)
    sums = np.zeros(len(b.data) + 1, np.uint64)
    np.cumsum(_codes[which][fold][b.data] * up[: len(b.data)], out=sums[1:])
    return mix((sums[b.ends] - sums[b.starts]) * down[b.starts] + (b.ends - b.starts).astype(np.uint64) * _STEP)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive entries (across documents too)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:k] + U(n))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``word_hashes`` gives, of separate words (already folded)."""
    joined = pa.array(words, pa.binary())
    raw, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    del joined
    b = Block(0, raw, offsets, offsets[:-1], offsets[1:], np.arange(len(words)))
    every = (np.ones(256, bool), np.arange(256, dtype=np.uint8))
    return word_hashes(b, every)
