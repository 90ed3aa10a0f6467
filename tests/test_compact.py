import itertools

import pytest
from pyspark.sql import functions as F

from tidemark import Catalog, Compactor, Policy
from tidemark.operators.compact import MB, entries_of, rows_per_part
from tidemark.operators.events import Events


@pytest.fixture()
def stamps(spark, tmp_path):
    clock = itertools.count(1000)
    c = Catalog(spark, str(tmp_path), "ws", clock=lambda: next(clock), events=Events(None))
    ds = c.create_dataset("t.stamps", spark.createDataFrame([], "timestamp bigint, value string").schema, author="ann", sort_orders=[0])
    for lo in (0, 500, 2000):
        ds.append(spark.range(lo, lo + 1000).select(F.col("id").alias("timestamp"), F.concat(F.lit("value_"), "id").alias("value")).coalesce(1), "ann")
    return ds


def entries(spark, *sizes, ranges=None):
    rows = [{"file_path": f"f{i}", "uncompressed_size_in_bytes": s * MB, "record_count": 10} for i, s in enumerate(sizes, 1)]
    for r, (lo, hi) in zip(rows, ranges or []):
        r |= {"min_values": [lo, None], "max_values": [hi, None]}
    return entries_of(spark, rows)


def test_strategy(stamps):
    assert (Compactor(stamps).strategy, Compactor(stamps).decision) == ("performance", "auto")
    assert (Compactor(stamps, "brute").strategy, Compactor(stamps, "brute").decision) == ("brute", "user")
    stamps.doc["sort-orders"] = []
    assert Compactor(stamps, "performance").decision == "no-sort"
    with pytest.raises(ValueError):
        Compactor(stamps, "other")


def test_plans(spark, stamps):
    brute, sorted_ = Compactor(stamps, "brute"), Compactor(stamps)
    assert brute.plan(entries(spark, 40, 50, 130)).files == ["f2", "f1"]
    assert brute.plan(entries(spark, 200)).kind == "split"
    assert brute.plan(entries(spark, 110, 135)) is None
    assert brute.plan(entries(spark)) is None
    assert brute.plan(entries(spark, 63)) is None
    p = sorted_.plan(entries(spark, 40, 50, 130, ranges=[(1, 100), (50, 150), (200, 300)]))
    assert (p.kind, p.reason, p.files, p.sort_column) == ("combine-split", "overlapping-ranges", ["f1", "f2"], "timestamp")
    assert sorted_.plan(entries(spark, 190, 190, ranges=[(1, 100), (50, 150)])) is None  # too large together
    assert sorted_.plan(entries(spark, 40, 50)).kind == "combine"  # no ranges
    assert rows_per_part(0, 0, 10) == 1 and rows_per_part(100, 10, 25) == 2


def test_run_keeps_the_rows_and_sorts_them(stamps):
    before = sorted(map(tuple, stamps.scan().collect()))
    total = stamps.snapshot().summary["total-data-size"]
    unit = total // 4
    c = Compactor(stamps, policy=Policy(target=unit, low=unit, high=unit, small=unit // 10, large=total, max_bytes=total))
    assert c.compact(dry_run=True).outputs >= 2
    done = c.compact_all()
    assert done and all(s.operation_type == "compact" and not s.user_created for s in done)
    assert sorted(map(tuple, stamps.scan().collect())) == before
    ranges = sorted((r["min_values"][0], r["max_values"][0]) for r in stamps.manifest().collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert stamps.scan(snapshot_id=stamps.snapshots()[0].snapshot_id).count() == 1000
    s = done[-1].summary
    assert s["total-records"] == 3000 and s["total-data-files"] == stamps.manifest().count()
