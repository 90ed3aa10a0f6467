import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import distogram as dg
from tidemark.functions.distogram import Distogram


def made(capacity, *pairs):
    h = Distogram(capacity)
    for v, f in pairs:
        h.update(v, f)
    return h


def test_update_merges_the_closest():
    h = Distogram(3)
    for v in (23, 28, 16, 23, 28, 16, 26):
        h.update(v)
    assert [(round(v, 3), f) for v, f in h.bins] == [(16, 2), (23, 2), (27.333, 3)]


def test_weights():
    h = made(3, (16, 4), (23, 3), (28, 5))
    assert h.count() == 12
    assert h.quantile(0.5) == pytest.approx(23.625)
    assert h.count_up_to(25) == pytest.approx(6.86)
    assert h.bin_size(24) == 5


def test_few_values():
    h = Distogram(10).load_many([12.3, 5.4, 8.2, 100.53, 23.5, 13.98])
    assert h.quantile(0.5) == pytest.approx(13.14)
    assert Distogram(10).load_many([1, 2, 3]).count_up_to(2.5) == pytest.approx(2)


def test_tails():
    left = Distogram(6)
    for v in (1, 2, 3, 4, 5, 6, 0.7, 1.1):
        left.update(v)
    assert left.count_up_to(0.77) == pytest.approx(0.45, abs=0.01)
    right = Distogram(6)
    for v in (1, 2, 3, 4, 5, 6, 6.7, 6.1):
        right.update(v)
    assert right.count_up_to(6.5) == pytest.approx(7.3077, abs=1e-3)


def test_invalid_and_empty():
    with pytest.raises(ValueError):
        Distogram().update(1, 0)
    h = Distogram()
    assert h.quantile(0.5) is None and h.count_up_to(1) is None and h.mean() is None and h.histogram() is None and h.density() is None
    h.update(1)
    assert h.quantile(1.5) is None and h.count_up_to(2) is None


def test_normal_sample():
    x = np.random.default_rng(1).normal(0, 1, 10_000)
    h = Distogram().load_many(x)
    assert h.count() == len(x) and h.bounds() == (x.min(), x.max())
    assert h.mean() == pytest.approx(x.mean(), abs=1e-9)
    assert h.variance() == pytest.approx(x.var(), abs=0.1)
    for q in (0.1, 0.25, 0.5, 0.9):
        assert h.quantile(q) == pytest.approx(np.quantile(x, q), abs=0.2)


def test_dump_and_load_and_add():
    h = made(5, (1, 2), (4, 1))
    back = Distogram.load(h.dumps())
    assert back.bins == h.bins and back.bounds() == h.bounds()
    both = h + made(5, (9, 3))
    assert both.count() == 6 and both.bounds() == (1, 9) and h.count() == 3
    assert dg.merge(None, h) is h and dg.merge(h, None) is h


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=200), st.integers(2, 30))
def test_weight_and_mean_are_kept(values, capacity):
    h = Distogram(capacity)
    for v in values:
        h.update(v)
    assert h.bin_count <= capacity
    assert h.count() == len(values)
    assert h.mean() == pytest.approx(np.mean(values), abs=1e-6)
    assert h.min == h.max or h.count_up_to(h.max) == len(values)


def test_sketch_column_agrees_with_the_class(spark):
    values = [None, float("nan")] + [float(v % 37) * 1.5 for v in range(500)]
    df = spark.createDataFrame([(v, "a" if i % 3 else None) for i, v in enumerate(values)], "x double, g string").repartition(3)
    h = Distogram().load_many([v for v in values if v is not None])
    row = dg.sketch(df, "x").select(
        dg.count(F.col("sketch")), dg.mean(F.col("sketch")), dg.variance(F.col("sketch")), dg.quantile(F.col("sketch"), 0.3), dg.count_up_to(F.col("sketch"), 20.2), dg.bin_size(F.col("sketch"), 3.2)
    ).first()
    assert list(row) == pytest.approx([h.count(), h.mean(), h.variance(), h.quantile(0.3), h.count_up_to(20.2), h.bin_size(3.2)])
    parts = {r["g"]: r["n"] for r in dg.sketch(df, "x", ["g"]).select("g", dg.count(F.col("sketch")).alias("n")).collect()}
    assert sum(parts.values()) == 500 and set(parts) == {None, "a"}
    got = dg.sketch(df, "x").select(dg.histogram(F.col("sketch"), 4).alias("p")).first()["p"]
    assert [tuple(p) for p in got] == [pytest.approx(p) for p in h.histogram(4)]
    assert dg.sketch(df.filter("x < 0"), "x").count() == 0


def test_single_updates_follow_the_definition():
    """Against a plain sketch that merges the two closest centroids after each value."""
    rng = np.random.default_rng(8)
    for capacity in (1, 2, 7, 50):
        h, bins = Distogram(capacity), []
        for x in np.round(rng.normal(size=3000), 3).tolist():
            h.update(x)
            bins = sorted([(v, f + 1) if v == x else (v, f) for v, f in bins] + [(x, 1)] * (x not in [v for v, _ in bins]))
            if len(bins) > capacity:
                k = min(range(len(bins) - 1), key=lambda i: bins[i + 1][0] - bins[i][0])
                (a, m), (b, n) = bins[k : k + 2]
                bins[k : k + 2] = [((a * m + b * n) / (m + n), m + n)]
        assert h.count() == 3000 and np.allclose(h.bins, bins)


def test_many_skewed_values_are_parted_by_rank():
    x = np.random.default_rng(2).lognormal(0, 2, 200_000)
    h, one = Distogram().load_many(x), Distogram()
    for v in x[:20_000].tolist():
        one.update(v)
    assert h.count() == len(x) and h.bounds() == (x.min(), x.max()) and np.isclose(h.mean(), x.mean())
    for q in (0.5, 0.9):  # as near as value by value
        true = np.quantile(x, q)
        assert abs(h.quantile(q) - true) <= 1.2 * abs(one.quantile(q) - true) + 0.05 * true
