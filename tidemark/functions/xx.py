"""Spark's xxhash64 of numbers, for whole arrays at once."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, prime in ((33, _P2), (29, _P3)):
        x = (x ^ (x >> np.uint64(shift))) * prime
    return x ^ (x >> np.uint64(32))


def xxhash64(v: np.ndarray) -> np.ndarray:
    """The hash that Spark gives each of some integers, floats, days or microseconds,
    as unsigned numbers: zeros are equal, and so are all NaN."""
    if v.dtype.kind == "f":
        v = np.where(np.isnan(v), np.array(np.nan, v.dtype), v + v.dtype.type(0))
        v = np.where(v == 0, v.dtype.type(0), v).view(np.int64 if v.dtype.itemsize == 8 else np.int32)
    if v.dtype.itemsize == 8:
        start = np.uint64((SEED + int(_P5) + 8) % 2**64)
        x = _turned(v.view(np.uint64) * _P2, 31) * _P1
        return _mixed(_turned(start ^ x, 27) * _P1 + _P4)
    start = np.uint64((SEED + int(_P5) + 4) % 2**64)
    x = v.astype(np.int32).view(np.uint32).astype(np.uint64) * _P1
    return _mixed(_turned(start ^ x, 23) * _P2 + _P3)
