"""A mergeable streaming histogram of at most ``capacity`` centroids with counts
(Ben-Haim & Tom-Tov): when it overflows, the two closest centroids become their
weighted mean. Up to ``capacity`` distinct values it is exact.

``Distogram`` is the sketch in memory. ``sketch`` builds one a group over any
number of rows: values are counted per Arrow batch, each task keeps one sketch a
group, and those are merged. The functions on a sketch column are plain Spark
expressions over ``struct<bins:array<struct<v:double,f:double>>,min,max>``.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ship import ship

CAPACITY = 50
#: Values that a task collects before it adds them to its sketches (8 bytes each).
HELD = 1 << 20
#: Values that ``update`` keeps until it puts them in.
LATE = 4096


class Distogram:
    """Sorted centroids ``v`` with counts ``f`` and the exact range."""

    def __init__(self, capacity: int = CAPACITY):
        if capacity < 1:
            raise ValueError("the capacity has to be positive")
        self.capacity = capacity
        self._v, self._f = np.zeros(0), np.zeros(0)
        self._min: float | None = None
        self._max: float | None = None
        self._late: list[tuple[float, float]] = []

    def _field(name: str) -> property:  # noqa: N805  made once, while the class is
        def get(self):
            if self._late:
                self._settle()
            return getattr(self, name)

        def put(self, value) -> None:
            if self._late:
                self._settle()
            setattr(self, name, value)

        return property(get, put)

    v, f, min, max = _field("_v"), _field("_f"), _field("_min"), _field("_max")
    del _field

    @property
    def bins(self) -> list[tuple[float, float]]:
        return list(zip(self.v.tolist(), self.f.tolist()))

    @property
    def max_bin_count(self) -> int:
        return self.capacity

    @property
    def bin_count(self) -> int:
        return len(self.v)

    def _put(self, v: np.ndarray, f: np.ndarray) -> None:
        both = np.concatenate([self.v, v])
        self.v, at = np.unique(both, return_inverse=True)
        self.f = np.bincount(at, np.concatenate([self.f, f]), len(self.v))
        while len(self.v) > self.capacity:
            i = int(np.argmin(np.diff(self.v)))
            f = self.f[i] + self.f[i + 1]
            self.v[i] = (self.v[i] * self.f[i] + self.v[i + 1] * self.f[i + 1]) / f
            self.f[i] = f
            self.v, self.f = np.delete(self.v, i + 1), np.delete(self.f, i + 1)

    def _range(self, lo: float, hi: float) -> None:
        self.min = lo if self.min is None or lo < self.min else self.min
        self.max = hi if self.max is None or hi > self.max else self.max

    def update(self, value: float, count: float = 1) -> Distogram:
        """Add a value ``count`` times. Values are kept in a list and put in when it is
        full, or when the sketch is looked at."""
        if count <= 0:
            raise ValueError("count has to be positive")
        self._late.append((value, count))
        if len(self._late) >= LATE:
            self._settle()
        return self

    def _settle(self) -> None:
        """Put the values of ``update`` in one by one, as they came."""
        late, self._late = self._late, []
        v, f, low, high = self._v.tolist(), self._f.tolist(), self._min, self._max
        cap = self.capacity
        gaps = [b - a for a, b in zip(v, v[1:])]
        for x, n in late:
            x = float(x)
            low, high = x if low is None or x < low else low, x if high is None or x > high else high
            i = bisect_left(v, x)
            if i < len(v) and v[i] == x:
                f[i] += n
                continue
            v.insert(i, x)
            f.insert(i, float(n))
            if i < len(v) - 1:
                gaps.insert(i, v[i + 1] - x)
            elif i:
                gaps.append(0.0)
            if i:
                gaps[i - 1] = x - v[i - 1]
            if len(v) > cap:
                if cap == 1:
                    k = 0
                else:
                    k = gaps.index(min(gaps))
                total = f[k] + f[k + 1]
                v[k] = (v[k] * f[k] + v[k + 1] * f[k + 1]) / total
                f[k] = total
                del v[k + 1], f[k + 1], gaps[k]
                if k < len(gaps):
                    gaps[k] = v[k + 1] - v[k]
                if k:
                    gaps[k - 1] = v[k] - v[k - 1]
        self._v, self._f, self._min, self._max = np.array(v, float), np.array(f, float), low, high

    def load_many(self, values: Iterable[float]) -> Distogram:
        """Add many values at once. Of over 5 x capacity distinct ones, neighbours by rank
        are first put together at their mean: parts of equally many values, finer towards
        both ends, and none of over twice its share unless it is one value."""
        x = np.asarray(values, float)
        x = np.sort(x[~np.isnan(x)])
        if not len(x):
            return self
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        v, n = x[new], np.diff(np.append(new, len(x))).astype(float)
        fine = 5 * self.capacity
        if len(v) > fine and np.isfinite(x[0]) and np.isfinite(x[-1]):
            share = (1 - np.cos(np.pi * np.arange(1, fine) / fine)) / 2  # narrow at the ends
            cuts = np.unique(np.searchsorted(np.cumsum(n), share * len(x), "left"))
            cuts = np.unique(np.concatenate([[0], cuts, cuts[cuts < len(v) - 1] + 1]))  # a frequent value stays alone
            w = np.add.reduceat(n, cuts)
            v, n = np.add.reduceat(v * n, cuts) / w, w
        self._put(v, n)
        self._range(float(x[0]), float(x[-1]))
        return self

    def merge(self, other: Distogram | None) -> Distogram:
        """Add the bins of another sketch; the capacity stays."""
        if other is not None and len(other.v):
            self._put(other.v, other.f)
            self._range(other.min, other.max)
        return self

    def __add__(self, other: Distogram) -> Distogram:
        return Distogram(self.capacity).merge(self).merge(other)

    def dump(self) -> dict:
        return {"bins": [list(b) for b in self.bins], "min": self.min, "max": self.max}

    def dumps(self) -> str:
        return json.dumps(self.dump())

    @classmethod
    def load(cls, doc: dict | str, capacity: int = CAPACITY) -> Distogram:
        doc = json.loads(doc) if isinstance(doc, str) else doc
        h = cls(max(capacity, len(doc["bins"])))
        h.v, h.f = np.array([b[0] for b in doc["bins"]], float), np.array([b[1] for b in doc["bins"]], float)
        h.min, h.max = doc["min"], doc["max"]
        return h

    # --- questions ---

    def count(self) -> float:
        return float(self.f.sum())

    def bounds(self) -> tuple[float | None, float | None]:
        return self.min, self.max

    def mean(self) -> float | None:
        return float((self.v * self.f).sum() / self.f.sum()) if len(self.v) else None

    def variance(self) -> float | None:
        """Of the population."""
        return float((self.f * (self.v - self.mean()) ** 2).sum() / self.f.sum()) if len(self.v) else None

    def stddev(self) -> float | None:
        return float(np.sqrt(self.variance())) if len(self.v) else None

    def count_up_to(self, x: float) -> float | None:
        """Estimated number of values up to ``x``; None outside of the range."""
        if not len(self.v) or x < self.min or x > self.max:
            return None
        if x == self.min:
            return 0.0
        if x == self.max:
            return self.count()
        v, f = self.v, self.f
        if x <= v[0]:
            return float((x - self.min) / (v[0] - self.min) * f[0] / 2)
        if x >= v[-1]:
            return float((1 + (x - v[-1]) / (self.max - v[-1])) * f[-1] / 2 + f[:-1].sum())
        i = int(np.searchsorted(v, x, "left")) - 1
        share = (x - v[i]) / (v[i + 1] - v[i])
        at = f[i] + (f[i + 1] - f[i]) * share
        return float((f[i] + at) / 2 * share + f[:i].sum() + f[i] / 2)

    def bin_size(self, x: float) -> float | None:
        """Count of the first bin above ``x``."""
        i = int(np.searchsorted(self.v, x, "right"))
        return float(self.f[i]) if i < len(self.v) else None

    def quantile(self, q: float) -> float | None:
        if not len(self.v) or not 0 <= q <= 1:
            return None
        v, f, c = self.v, self.f, float(int(self.count() * q))
        if c <= f[0] / 2:
            return float(self.min + c / (f[0] / 2) * (v[0] - self.min))
        if c >= self.count() - f[-1] / 2:
            return float(v[-1] + (c - (self.count() - f[-1] / 2)) / (f[-1] / 2) * (self.max - v[-1]))
        mids = (f[1:] + f[:-1]) / 2
        sums = np.cumsum(mids)
        m = c - f[0] / 2
        i = min(int(np.searchsorted(sums, m, "right")), len(mids) - 1)
        return float(v[i] + (m - (sums[i] - mids[i])) / mids[i] * (v[i + 1] - v[i]))

    def histogram(self, bin_count: int = 20) -> list[tuple[float, float, float]] | None:
        """(low, high, count) of equal parts of the range; None of fewer than two bins."""
        k = min(bin_count, len(self.v))
        if k < 2:
            return None
        edges = [self.min + (self.max - self.min) * i / k for i in range(k)] + [self.max]
        up = [self.count_up_to(e) for e in edges]
        return [(edges[i], edges[i + 1], up[i + 1] - up[i]) for i in range(k)]

    def density(self) -> tuple[list[float], list[float]] | None:
        """Density between neighbouring centroids, and the centroids."""
        if self.count() < 2:
            return None
        up = [0.0, *[self.count_up_to(x) for x in self.v[1:]]]
        return [(up[i + 1] - up[i]) / (self.v[i + 1] - self.v[i]) for i in range(len(up) - 1)], self.v.tolist()


def merge(a: Distogram | None, b: Distogram | None) -> Distogram | None:
    """Merge two sketches into the first; either may be missing."""
    return b if a is None else a.merge(b)


# --- over DataFrames ------------------------------------------------------------


def sketch(df: DataFrame, column: str, by: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(by..., sketch): a sketch of a numeric column, over all rows or a group.
    Nulls and NaN are left out; a group of nothing else has no row."""
    ship(df.sparkSession)
    by = by or []
    rows = df.select(*by, F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    keys = T.StructType([df.schema[b] for b in by])
    out = T.StructType([*keys, T.StructField("dump", T.StringType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame | pa.RecordBatch]:
        state: dict[tuple, Distogram] = {}

        def take(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            if not by:
                state.setdefault((), Distogram(capacity)).load_many(np.asarray(t.column(0)))
                return
            for key, own in t.to_pandas().groupby(by, dropna=False, sort=False)["_x"]:
                state.setdefault(tuple(None if pd.isna(k) else k for k in key), Distogram(capacity)).load_many(own.to_numpy())

        held, n, schema = [], 0, None
        for b in batches:
            held, n, schema = [*held, b], n + b.num_rows, b.schema
            if n >= HELD:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        if state:
            cols = [pa.array([k[i] for k in state], schema.field(i).type) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([h.dumps() for h in state.values()], pa.string())], [*by, "dump"])

    return merge_sketches(rows.mapInArrow(partial, out).select(*by, F.from_json("dump", _JSON).alias("sketch")), by, capacity)


_JSON = "bins array<array<double>>, min double, max double"


def merge_sketches(sketches: DataFrame, by: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(by..., sketch) of the union of sketches, merged in order of their bins so
    that the result doesn't depend on which task was first."""
    by = by or []
    bins = F.col("sketch.bins")
    if "array<array" not in sketches.schema["sketch"].dataType.simpleString():
        bins = F.transform(bins, lambda b: F.array(b["v"], b["f"]))
    dumps = sketches.select(*by, F.to_json(F.struct(bins.alias("bins"), F.col("sketch.min").alias("min"), F.col("sketch.max").alias("max"))).alias("d"))
    grouped = dumps.groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("ds"))

    @F.pandas_udf("string")
    def together(lists: pd.Series) -> pd.Series:
        def one(ds) -> str | None:
            h = Distogram(capacity)
            for d in ds:
                h.merge(Distogram.load(d, capacity))
            return h.dumps() if len(h.v) else None

        return lists.map(one)

    read = F.from_json(together("ds"), _JSON)
    done = grouped.select(*by, read.alias("r")).filter("r is not null")
    typed = F.struct(F.transform("r.bins", lambda b: F.struct(b[0].alias("v"), b[1].alias("f"))).alias("bins"), F.col("r.min").alias("min"), F.col("r.max").alias("max"))
    return done.select(*by, typed.alias("sketch"))


def _sum(bins: Column, what) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda s, b: s + what(b))


def count(h: Column) -> Column:
    return _sum(h["bins"], lambda b: b["f"])


def mean(h: Column) -> Column:
    return F.when(F.size(h["bins"]) > 0, _sum(h["bins"], lambda b: b["v"] * b["f"]) / count(h))


def variance(h: Column) -> Column:
    m = mean(h)
    return F.when(F.size(h["bins"]) > 0, _sum(h["bins"], lambda b: b["f"] * (b["v"] - m) * (b["v"] - m)) / count(h))


def stddev(h: Column) -> Column:
    return F.sqrt(variance(h))


def bin_count(h: Column) -> Column:
    return F.size(h["bins"])


def _first(h: Column, field: str) -> Column:
    return F.get(h["bins"], F.lit(0))[field]


def _last(h: Column, field: str) -> Column:
    return F.get(h["bins"], F.size(h["bins"]) - 1)[field]


def count_up_to(h: Column, x) -> Column:
    x = (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    below = F.filter(h["bins"], lambda b: b["v"] < x)
    i = F.size(below) - 1
    vi, fi, vj, fj = F.get(h["bins"], i)["v"], F.get(h["bins"], i)["f"], F.get(h["bins"], i + 1)["v"], F.get(h["bins"], i + 1)["f"]
    share = (x - vi) / (vj - vi)
    middle = (fi + (fi + (fj - fi) * share)) / 2.0 * share + (_sum(below, lambda b: b["f"]) - fi) + fi / 2.0
    right = (F.lit(1.0) + (x - _last(h, "v")) / (h["max"] - _last(h, "v"))) * _last(h, "f") / 2.0 + (count(h) - _last(h, "f"))
    left = (x - h["min"]) / (_first(h, "v") - h["min"]) * _first(h, "f") / 2.0
    return (
        F.when((F.size(h["bins"]) == 0) | (x < h["min"]) | (x > h["max"]), F.lit(None).cast("double"))
        .when(x == h["min"], F.lit(0.0))
        .when(x == h["max"], count(h))
        .when(x <= _first(h, "v"), left)
        .when(x >= _last(h, "v"), right)
        .otherwise(middle)
    )


def bin_size(h: Column, x) -> Column:
    x = (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    return F.get(F.filter(h["bins"], lambda b: b["v"] > x), F.lit(0))["f"]


def quantile(h: Column, q) -> Column:
    q = (q if isinstance(q, Column) else F.lit(float(q))).cast("double")
    c = F.floor(count(h) * q).cast("double")
    f0, fl, v0, vl = _first(h, "f"), _last(h, "f"), _first(h, "v"), _last(h, "v")
    m = c - f0 / 2.0

    def step(s: Column, i: Column) -> Column:
        a, b = F.get(h["bins"], i), F.get(h["bins"], i + 1)
        mid = (a["f"] + b["f"]) / 2.0
        here = s["r"].isNull() & (m < s["t"] + mid)
        return F.struct((s["t"] + mid).alias("t"), F.when(here, a["v"] + (m - s["t"]) / mid * (b["v"] - a["v"])).otherwise(s["r"]).alias("r"))

    start = F.struct(F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("r"))
    middle = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(h["bins"]) - 2, F.lit(0))), start, step, lambda s: s["r"])
    return (
        F.when((F.size(h["bins"]) == 0) | (q < 0) | (q > 1), F.lit(None).cast("double"))
        .when(c <= f0 / 2.0, h["min"] + c / (f0 / 2.0) * (v0 - h["min"]))
        .when(c >= count(h) - fl / 2.0, vl + (c - (count(h) - fl / 2.0)) / (fl / 2.0) * (h["max"] - vl))
        .otherwise(middle)
    )


def histogram(h: Column, bins: int = 20) -> Column:
    """array<struct<lo,hi,count>> of equal parts of the range."""
    k = F.least(F.lit(bins), F.size(h["bins"]))
    edge = lambda i: F.when(i == k, h["max"]).otherwise(h["min"] + (h["max"] - h["min"]) * i.cast("double") / k.cast("double"))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
        lambda i: F.struct(edge(i).alias("lo"), edge(i + 1).alias("hi"), (count_up_to(h, edge(i + 1)) - count_up_to(h, edge(i))).alias("count")),
    )
    return F.when(k >= 2, parts)


def density(h: Column) -> Column:
    """array<struct<lo,hi,density>> between neighbouring centroids."""
    v = lambda i: F.get(h["bins"], i)["v"]
    up = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(count_up_to(h, v(i)))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h["bins"]) - 2, F.lit(0))),
        lambda i: F.struct(v(i).alias("lo"), v(i + 1).alias("hi"), ((up(i + 1) - up(i)) / (v(i + 1) - v(i))).alias("density")),
    )
    return F.when((count(h) >= 2) & (F.size(h["bins"]) >= 2), parts)


def dumps(h: Column) -> Column:
    return F.to_json(h)


def loads(c: Column) -> Column:
    return F.from_json(c, "bins array<struct<v:double,f:double>>, min double, max double")
