import itertools
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import Catalog, CommitConflict, DatasetAlreadyExists, DatasetNotFound, ViewNotFound
from tidemark.operators import inspect as ins
from tidemark.operators import manifest as mf
from tidemark.operators.describe import describe
from tidemark.operators.events import Events, HttpSink, MemorySink, QueueSink, view_executed

PLANETS = ["Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune"]


@pytest.fixture()
def catalog(spark, tmp_path):
    clock = itertools.count(1000)
    return Catalog(spark, str(tmp_path), "ws", clock=lambda: next(clock), events=Events(MemorySink()))


@pytest.fixture()
def planets(spark, catalog):
    df = spark.createDataFrame(list(enumerate(PLANETS, 1)), "id bigint, name string")
    ds = catalog.create_dataset("space.planets", df.schema, author="ann", sort_orders=[0])
    ds.append(df, "ann")
    ds.append(spark.createDataFrame([(9, "Pluto"), (10, "Eris")], df.schema), "ann", "append extra planets")
    return ds


@pytest.mark.parametrize(
    "where, n",
    [("name = 'Earth'", 1), ("name = 'Xenon'", 0), ("name IN ('Earth', 'Mars')", 2), ("name IN ('a', 'b')", 0), ("name IN ('Venus')", 1), (None, 10), ([], 0)],
)
def test_planets(planets, where, n):
    where = F.col("name").isin(where) if isinstance(where, list) else where
    assert planets.scan(where).count() == n


def test_versions(planets):
    first, second = planets.snapshots()
    assert planets.scan(snapshot_id=first.snapshot_id).count() == 8
    assert planets.scan(as_of_timestamp=first.timestamp_ms).count() == 8
    assert planets.scan(snapshot_id=5).count() == 0
    assert second.commit_message == "append extra planets" and second.parent_snapshot_id == first.snapshot_id
    assert second.summary["added-records"] == 2 and second.summary["total-records"] == 10
    assert planets.scan("id > 8").inputFiles() and planets.scan_files("id > 8").count() < planets.scan_files().count()


def test_empty_dataset(spark, catalog):
    ds = catalog.create_dataset("tmp.test", spark.createDataFrame([], "a bigint").schema, author="ann")
    assert ds.snapshot() is None and ds.snapshots() == [] and ds.next_sequence_number() == 1
    assert ds.scan().count() == 0 and ds.scan_files().count() == 0
    with pytest.raises(ValueError):
        ds.describe()
    with pytest.raises(ValueError):
        ds.refresh_manifest("robot")


def test_truncate_survives_a_reload(planets, catalog):
    planets.truncate("ann")
    again = catalog.load_dataset("space.planets")
    assert again.scan().count() == 0
    assert again.snapshot().summary["deleted-records"] == 10
    assert again.snapshot().operation_type == "truncate" and again.doc["sort-orders"] == [0]


def test_writes_are_checked(spark, planets):
    with pytest.raises(ValueError, match="author"):
        planets.append(planets.scan(), "")
    with pytest.raises(ValueError, match="not those"):
        planets.append(spark.createDataFrame([(1,)], "id bigint"), "ann")
    assert planets.next_sequence_number() == 3


def test_append_of_a_scan_of_itself(planets):
    planets.append(planets.scan(), "ann")
    assert planets.scan().count() == 20


def test_concurrent_appends_are_kept(spark, catalog, planets):
    one, two = catalog.load_dataset("space.planets"), catalog.load_dataset("space.planets")
    df = spark.createDataFrame([(11, "Ceres")], planets.schema())
    done = []
    runs = [threading.Thread(target=lambda d=d: done.append(d.append(df, "ann"))) for d in (one, two)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert len(done) == 2 and catalog.load_dataset("space.planets").scan().count() == 12


def test_overwrite_conflict(planets, catalog, monkeypatch):
    other = catalog.load_dataset("space.planets")
    planets.append(planets.scan(), "ann")
    monkeypatch.setattr(other, "snapshot", lambda *a: other._load(2))
    with pytest.raises(CommitConflict):
        other.overwrite(other.scan(), "ben")


def test_statistics_of_every_type(spark, catalog):
    df = spark.createDataFrame(
        [(True, 5, 1.5, "b" * 20, bytearray(b"\x01\xff"), [1]), (False, None, float("nan"), "é", None, None), (None, 7, -2.5, None, bytearray(b"\x00"), [2, 3])],
        "f boolean, i int, x double, s string, b binary, a array<int>",
    ).coalesce(1)
    ds = catalog.create_dataset("t.types", df.schema, author="ann")
    ds.append(df, "ann")
    m = ds.manifest().first()
    assert m["record_count"] == 3 and m["null_counts"] == [1, 1, 0, 1, 1, 1] and m["nan_counts"][2] == 1
    assert m["min_values"][:3] == [0, 5, -3] and m["max_values"][:3] == [1, 7, 1]
    assert m["histogram_counts"][0] == [1, 1] and sum(m["histogram_counts"][1]) == 2 and m["histogram_counts"][5] == []
    assert [len(h) for h in m["min_k_hashes"]] == [0, 2, 3, 2, 2, 0]
    assert m["min_values_display"][3] == "b" * 16 + "..." and m["max_values_display"][3] == "é"
    assert m["min_values_display"][4] == "00" and m["min_values"][5] is None
    assert ins.verify_manifest(ds).count() == 0
    assert ds.scan("x > 5").count() == 1  # NaN is greater than any number
    assert ds.scan("s = 'é'").count() == 1 and ds.scan("a IS NULL").count() == 1


def test_all_null_column_has_no_range(spark, catalog):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string").coalesce(1)
    ds = catalog.create_dataset("t.nulls", df.schema, author="ann")
    ds.append(df, "ann")
    row = {r["column"]: r for r in ds.describe().collect()}["b"]
    assert row["min"] is None and row["null_count"] == 2 and row["cardinality"] == 0 and row["cardinality_is_exact"]
    assert ds.scan_files("b = 'x'").count() == 0 and ds.scan_files("b IS NULL").count() == 1


def test_describe_adds_up_bytes(spark):
    entries = [("f1", "parquet", 10, 100, 1000, [100, 400], [0, 0], [[1], [2]], [[1, 2], [3]], 32, [10, 20], [100, 400], [], [], []), ("f2", "parquet", 20, 200, 2000, [300, 200], [0, 0], [[1], []], [[3, 4], []], 32, [5, 30], [300, 200], [], [], [])]
    from decimal import Decimal

    entries = [tuple([[Decimal(x) for x in h] for h in v] if i == 7 else v for i, v in enumerate(e)) + (None,) for e in entries]
    m = spark.createDataFrame(entries, mf.SCHEMA)
    rows = {r["column"]: r for r in describe(m, spark.createDataFrame([], "a bigint, b bigint").schema, "d", None).collect()}
    assert rows["a"]["uncompressed_bytes"] == 400 and rows["b"]["uncompressed_bytes"] == 600
    assert rows["a"]["min"] == 5 and rows["a"]["max"] == 300 and rows["a"]["row_count"] == 30


_VALUES = st.one_of(st.none(), st.sampled_from(["same-prefix-a", "same-prefix-b", "", "z", "é", "same-pr"]))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), _VALUES, st.one_of(st.none(), st.floats(allow_nan=True, width=32))), min_size=1, max_size=12))
def test_pruning_never_changes_a_result(spark, tmp_path_factory, rows):
    c = Catalog(spark, str(tmp_path_factory.mktemp("prune")), "ws", events=Events(None))
    schema = "i int, s string, x double"
    ds = c.create_dataset("t.t", spark.createDataFrame([], schema).schema, author="ann")
    for part in (rows[::2], rows[1::2]):
        if part:
            ds.append(spark.createDataFrame(part, schema).coalesce(1), "ann")
    for where in ("i >= 2", "i < 0 OR s = 'same-prefix-b'", "s IN ('é', 'q')", "x > 0.5", "x <= 0", "x = double('NaN')", "i IS NULL", "s IS NOT NULL AND NOT i = 1", "3 > i", "s > 'same-prefix-a'", "i = 2.5", "x = 1e300"):
        assert sorted(map(str, ds.scan(where).collect())) == sorted(map(str, spark.createDataFrame(rows, schema).filter(where).collect())), where


def test_sum_of_histograms(planets):
    for r in mf.per_column(planets.manifest(), ["id", "name"]).collect():
        assert not r["bins"] or sum(r["bins"]) == r["record_count"] - r["nulls"]


def test_refresh_keeps_entries_of_missing_files(planets, catalog):
    path = planets.manifest().select("file_path").first()[0]
    planets.store.delete(path)
    planets.refresh_manifest("robot")
    assert planets.manifest().filter(F.col("file_path") == path).count() == 1


def test_catalog(catalog, spark, planets):
    with pytest.raises(DatasetAlreadyExists):
        catalog.create_dataset("space.planets", planets.schema(), author="ann")
    with pytest.raises(KeyError):
        catalog.load_dataset("space.none")
    with pytest.raises(ValueError):
        catalog.dataset_exists("planets")
    catalog.create_view(("space", "outer"), "SELECT * FROM ws.space.planets WHERE id > 4", author="ann")
    assert catalog.load_view("space.outer").run().count() == 6
    assert catalog.list_views("space") == ["outer"] and catalog.list_datasets("space") == ["planets"]
    catalog.drop_view("space.outer")
    with pytest.raises(ViewNotFound):
        catalog.load_view("space.outer")
    catalog.drop_dataset("space.planets")
    catalog.drop_dataset("space.planets")
    with pytest.raises(DatasetNotFound):
        catalog.load_dataset("space.planets")
    assert {e["event"]["action"] for e in catalog.events.sink.sent} >= {"create", "delete", "execute"}


def test_sinks():
    assert Events(None).send("a", "w", "c", "t", "n") is False

    def broken(*a, **k):
        raise OSError

    assert Events(HttpSink("example.org", opener=broken)).send("a", "w", "c", "t", "n") is False
    queue = []
    assert Events(QueueSink("example.org", lambda u, b: queue.append(u))).send("a", "w", "c", "t", "n") and queue == ["https://example.org/event"]
    assert view_executed(1500, 100) == {"execution_time_ms": 1500, "row_count": 100}


def test_commits_hold_rows_of_any_value(spark, catalog):
    from tidemark.plans.fixtures import commits

    df = spark.createDataFrame([(1, "F"), (2, "O"), (3, None), (4, "X")], "id bigint, status string")
    ds = commits(catalog, "sales.all", df, F.col("status"), ("F", "O"))
    assert sorted(r["id"] for r in ds.scan().collect()) == [1, 2, 3, 4]
    listed = commits(catalog, "sales.listed", df.filter("id < 3"), F.col("status"), ("F", "O"))
    assert listed.scan().count() == 2 and len(ds.snapshots()) == len(listed.snapshots()) + 1


def test_statistics_follow_their_columns(spark, catalog):
    v1 = spark.createDataFrame([(1, 500, "a"), (2, 600, "b")], "id long, amount long, note string")
    ds = catalog.create_dataset("t.moved", v1.schema, author="ann")
    ds.append(v1, "ann")
    v2 = spark.createDataFrame([(7, 3, 1.5)], "amount long, id long, extra double")
    catalog.set_schema("t.moved", v2.schema, "ben")
    ds.refresh().append(v2, "ann")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(ds.scan("amount = 500")) == [(500, 1, None)]
    assert rows(ds.scan("id = 3")) == [(7, 3, 1.5)]
    assert rows(ds.scan("extra IS NULL")) == [(500, 1, None), (600, 2, None)]
    assert ds.scan_files("amount = 7").count() == 1
    first = ds.snapshots()[0].snapshot_id
    assert rows(ds.scan("note = 'a'", snapshot_id=first)) == [(1, 500, "a")]
    told = {r["column"]: (r["min"], r["max"], r["null_count"]) for r in ds.describe().collect()}
    assert told == {"amount": (7, 600, 0), "id": (1, 3, 0), "extra": (1, 1, 2)}
    assert {r["column"] for r in ds.describe(first).collect()} == {"id", "amount", "note"}
    # a column of another type is read by a cast, and its statistics aren't used
    v3 = spark.createDataFrame([("x", 9)], "amount string, id long")
    catalog.set_schema("t.moved", v3.schema, "ben")
    ds.refresh().append(v3, "ann")
    assert rows(ds.scan("amount = '500'")) == [("500", 1)]
    assert ds.scan_all_versions().count() == 4


def test_many_commits_share_parts_and_are_put_together(spark, catalog, monkeypatch):
    from tidemark.operators import dataset

    monkeypatch.setattr(dataset, "PARTS", 2)
    df = spark.createDataFrame([(1,)], "id long")
    ds = catalog.create_dataset("t.parts", df.schema, author="ann")
    snapshots = [ds.append(df, "ann") for _ in range(4)]
    assert [len(s.parts) for s in snapshots] == [1, 2, 1, 2] and snapshots[1].parts[0] == snapshots[0].parts[0]
    assert [ds.scan(snapshot_id=s.snapshot_id).count() for s in snapshots] == [1, 2, 3, 4]


def test_exclusive_documents_on_another_file_system(spark, tmp_path):
    from tidemark.sources.store import FileStore

    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tm.link./w", f"file://{tmp_path}")
    store = FileStore(spark)
    assert store.create("viewfs://tm/w/a/1.json", "one") and not store.create("viewfs://tm/w/a/1.json", "two")
    assert store.read("viewfs://tm/w/a/1.json") == "one" and store.names("viewfs://tm/w/a") == ["1.json"] and store.exists("viewfs://tm/w/a/1.json")
    store.replace("viewfs://tm/w/a/1.json", "three")
    assert store.read("viewfs://tm/w/a/1.json") == "three"
    store.delete("viewfs://tm/w/a")
    assert store.names("viewfs://tm/w/a") == []
    with pytest.raises(Exception, match="exclusively|No FileSystem"):
        store.create("ftp://nowhere/x", "one")


def test_added_files_count_once_whatever_their_names(spark, catalog, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    path = tmp_path / "a b+c%20.parquet"
    next((tmp_path / "in").glob("*.parquet")).rename(path)
    ds = catalog.create_dataset("t.named", df.schema, author="ann")
    for name in (str(path), f"file://{path}", str(path)):
        s = ds.add_files([name, name], "ann")
    assert s.summary["total-data-files"] == 1 and ds.scan().count() == 2 and ds.scan("id = 2").count() == 1
    assert ins.verify_manifest(ds).count() == 0


def test_a_batch_is_appended_once(spark, catalog, tmp_path):
    from tidemark.streaming.sink import append_stream

    df = spark.createDataFrame([(1,), (2,)], "id long")
    df.write.parquet(str(tmp_path / "in"))
    ds = catalog.create_dataset("t.streamed", df.schema, author="ann")
    run = lambda at: append_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ds, "ann", at).awaitTermination()
    run(f"{tmp_path}/check")
    assert ds.refresh().scan().count() == 2 and list(ds.doc["streams"].values()) == [[0, 1]]
    # the commit was made, the mark wasn't, and the batch comes again
    import shutil

    catalog._patch_dataset("t.streamed", {"streams": {}})
    shutil.rmtree(f"{tmp_path}/check/commits")
    run(f"{tmp_path}/check")
    assert ds.refresh().scan().count() == 2 and list(ds.doc["streams"].values()) == [[0, 1]]


def test_split_reads_each_part_alone(spark, catalog):
    from tidemark.plans.fixtures import split

    df = spark.range(90).select("id", F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit(None), F.lit("X")), (F.col("id") % 4 + 1).cast("int")).alias("status")).repartition(5)
    parts = split(df, F.col("status"), ("F", "none", "O"))
    assert [p.count() for p in parts] == [23, 0, 23, 44] and [p.rdd.getNumPartitions() for p in parts] == [1] * 4
    files = [f for p in parts for f in p.inputFiles()]
    assert len(files) == len(set(files)) and {r["status"] for r in parts[2].collect()} == {"O"}
    assert [p.count() for p in split(df.filter("status = 'F'"), F.col("status"), ("F", "O"))] == [23, 0]


def test_frames_written_together_are_committed_one_by_one(spark, catalog):
    df = spark.createDataFrame([(1, "F"), (2, "O"), (3, "O"), (4, None)], "id bigint, status string")
    ds = catalog.create_dataset("sales.each", df.schema, author="ann")
    one, none, more = ds.write_each([df.filter("id = 1"), df.filter("id > 9"), df.filter("id > 1")], "ann")
    assert ds.snapshot() is None
    ds.append(one, "ann")
    ds.append(none, "ann")
    assert [r["id"] for r in ds.scan().collect()] == [1]
    ds.overwrite(more, "ann")
    alone = catalog.create_dataset("sales.alone", df.schema, author="ann")
    alone.append(df.filter("id > 1"), "ann")
    columns = [c for c in mf.SCHEMA.names if c not in ("file_path", "file_size_in_bytes", "schema_id")]
    entry = lambda d: sorted(map(tuple, mf.per_column(d.manifest(), df.columns).drop("file_path").distinct().collect()))
    assert entry(ds) == entry(alone) and ds.manifest().select(columns).agg(F.sum("record_count")).first()[0] == 3
    assert ds.snapshot().summary["added-records"] == 3 and ds.snapshots()[1].summary["added-data-files"] == 0
    with pytest.raises(ValueError):
        ds.append(one, "")
    catalog.set_schema("sales.each", spark.createDataFrame([], "id bigint").schema, "ben")
    with pytest.raises(ValueError):
        ds.refresh().append(one, "ann")
    with pytest.raises(ValueError):
        ds.write_each([df], "ann")


def test_statistics_match_plain_expressions(spark, catalog):
    from datetime import date, datetime
    from decimal import Decimal

    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 2, 1.5, 2.5, True, date(1969, 12, 30), datetime(1960, 1, 2, 3), "zebra and a longer text", b"\xff" * 20, Decimal("12.34"), [1, 2], -7),
        (-(2**62), -5, nan, nan, None, date(2200, 1, 1), datetime(2100, 1, 1), "\u00e9\u00e9\u00e9\u00e9\u00e9", b"", Decimal("-0.01"), None, None),
        (None, None, None, -inf, False, None, None, None, None, None, [], 9),
        (7, 3, -0.0, 0.0, True, date(2000, 2, 29), datetime(1999, 5, 6), "", b"\x00a", Decimal("99.99"), [5], 3),
        (7, 3, 3.25, inf, True, date(2000, 2, 29), datetime(1999, 5, 6), "a", b"\x00a", Decimal("99.99"), [5], 3),
    ]
    ddl = "a long, b int, c float, d double, e boolean, f date, g timestamp, h string, i binary, j decimal(10,2), k array<int>, l short"
    df = spark.createDataFrame(rows, ddl).withColumn("m", F.col("g").cast("timestamp_ntz")).coalesce(1)
    from tidemark.functions import columns as fc

    for method in ("xxhash64", "md5"):
        ds = catalog.create_dataset(f"t.{method}", df.schema, {"sketch-hash": method}, author="ann")
        ds.append(df, "ann")
        for r in mf.per_column(ds.manifest(), df.columns).collect():
            c, t = F.col(r["column"]), df.schema[r["column"]].dataType
            o, kind = fc.ordinal(c, t), fc.kind(t)
            want = df.agg(F.count_if(c.isNull()), F.min(o), F.max(o), F.count_if(F.isnan(c)) if kind == "float" else F.lit(0)).first()
            assert (r["nulls"], r["low"], r["high"], r["nans"]) == tuple(want), r["column"]
            if kind in ("other", "bool"):
                continue
            hashes = {h % 2**64 for (h,) in df.select(fc.hash64(c, t, method)).collect() if h is not None}
            assert [int(h) for h in r["hashes"]] == sorted(hashes), (method, r["column"])
            bins = df.filter(o.isNotNull()).select(fc.bin_index(o, F.lit(want[1]), F.lit(want[2])).alias("x")).groupBy("x").count().collect()
            assert {i: n for i, n in enumerate(r["bins"]) if n} == {x: n for x, n in bins}, r["column"]
            if kind not in ("string", "binary"):
                assert (r["low_display"], r["high_display"]) == tuple(df.agg(F.min(c).cast("string"), F.max(c).cast("string")).first()), r["column"]


def test_short_rows_of_a_file_are_measured_by_several_tasks(spark, catalog):
    import pyarrow.parquet as pq

    df = spark.range(600_000).coalesce(1)
    ds = catalog.create_dataset("t.short", df.schema, author="ann")
    ds.append(df, "ann")
    (path,) = ds.scan().inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    groups = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) == 600_000 and max(groups) <= 1 << 18
    assert ds.manifest().first()["record_count"] == 600_000


def test_md5_of_whole_numbers_and_short_texts_is_taken_once_a_batch(spark, catalog):
    from tidemark.functions import columns as fc

    texts = F.when(F.col("id") % 5 > 0, F.concat(F.repeat(F.lit("é"), (F.col("id") % 40).cast("int")), (F.col("id") % 3).cast("string")))
    df = spark.range(-50, 150).select("id", (F.col("id") % 7).cast("byte").alias("n"), texts.alias("t"), F.timestamp_micros(F.col("id") * 10**9).alias("at")).coalesce(1)
    ds = catalog.create_dataset("t.digests", df.schema, {"sketch-hash": "md5"}, author="ann")
    ds.append(df, "ann")
    for r in mf.per_column(ds.manifest(), df.columns).collect():
        hashes = {h % 2**64 for (h,) in df.select(fc.hash64(F.col(r["column"]), df.schema[r["column"]].dataType, "md5")).collect() if h is not None}
        assert [int(h) for h in r["hashes"]] == sorted(hashes)[:32], r["column"]
    rows = df.select(F.lit("p").alias("_path"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    plan = mf._second_pass(rows, df.schema, {}, "md5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1  # of texts that are not short
