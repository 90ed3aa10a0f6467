"""One query for each operator of the library."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import distogram as dg
from tidemark.functions import kmv, scalars
from tidemark.operators import events as ev
from tidemark.operators import inspect as ins
from tidemark.operators import manifest as mf
from tidemark.operators.compact import MB, Compactor, Policy, entries_of, rows_per_part
from tidemark.operators.dataset import Dataset
from tidemark.plans import fixtures as fx
from tidemark.streaming.sink import append_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# --- scans ------------------------------------------------------------------------


@query
def pricing_summary(spark, d):
    li = fx.lineitem(spark, d).scan("l_shipdate <= timestamp_ntz'2000-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query
def scan_current(spark, d):
    return fx.orders(spark, d).scan()


@query
def scan_time_travel(spark, d):
    ds = fx.orders(spark, d)
    return ds.scan(snapshot_id=ds.snapshots()[0].snapshot_id)


@query
def scan_as_of(spark, d):
    ds = fx.orders(spark, d)
    return ds.scan(as_of_timestamp=ds.snapshots()[1].timestamp_ms)


@query
def scan_unknown_snapshot_count(spark, d):
    return fx.orders(spark, d).scan(snapshot_id=1).agg(F.count("*").alias("n"))


@query
def scan_filter_range(spark, d):
    return fx.lineitem(spark, d).scan("l_shipdate >= timestamp_ntz'1998-03-01 00:00:00' AND l_shipdate < timestamp_ntz'1999-02-01 00:00:00' AND l_quantity < 10")


@query
def scan_filter_column(spark, d):
    return fx.lineitem(spark, d).scan((F.year("l_shipdate") == 1997) & (F.col("l_discount") > 0.08))


@query
def scan_filter_eq(spark, d):
    return fx.orders(spark, d).scan("o_orderpriority = '1-URGENT'")


@query
def scan_filter_eq_none_count(spark, d):
    return fx.orders(spark, d).scan("o_orderpriority = 'Xenon'").agg(F.count("*").alias("n"))


@query
def scan_filter_in(spark, d):
    return fx.orders(spark, d).scan("o_orderstatus IN ('F', 'P')")


@query
def scan_filter_in_single(spark, d):
    return fx.orders(spark, d).scan(F.col("o_orderstatus").isin("O"))


@query
def scan_filter_in_none_count(spark, d):
    return fx.orders(spark, d).scan("o_orderstatus IN ('X', 'Y')").agg(F.count("*").alias("n"))


@query
def scan_filter_in_empty_count(spark, d):
    return fx.orders(spark, d).scan(F.col("o_orderstatus").isin([])).agg(F.count("*").alias("n"))


@query
def scan_filter_null(spark, d):
    return fx.events(spark, d).scan("value IS NULL", columns=["event_id", "event_type"])


@query
def scan_projection(spark, d):
    return fx.orders(spark, d).scan(columns=["o_orderkey", "o_totalprice"])


@query
def scan_row_limit(spark, d):
    top = fx.orders(spark, d).scan().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", "o_totalprice")


@query
def scan_row_limit_count(spark, d):
    return fx.orders(spark, d).scan(row_limit=50).agg(F.count("*").alias("n"))


@query
def scan_pruned_file_count(spark, d):
    ds = fx.lineitem(spark, d)
    wheres = {
        "range": "l_shipdate >= timestamp_ntz'1998-03-01 00:00:00' AND l_shipdate < timestamp_ntz'1999-02-01 00:00:00'",
        "or": "l_shipdate < timestamp_ntz'1996-01-01 00:00:00' OR l_shipdate >= timestamp_ntz'2001-01-01 00:00:00'",
        "none": "l_quantity > 1000",
        "null": "l_tax IS NULL",
        "opaque": "length(l_returnflag) = 1",
    }
    counts = [ds.scan_files(w).agg(F.lit(k).alias("filter"), F.count("*").alias("files")) for k, w in wheres.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query
def scan_files_accessors(spark, d):
    label = F.get("min_values_display", F.lit(2))
    return fx.orders(spark, d).scan_files().select(
        label.alias("status"), "file_format", "record_count", "histogram_bins", F.size("min_k_hashes").alias("sketches"),
        (F.col("file_size_in_bytes") > 0).alias("sized"), F.endswith("file_path", F.lit(".parquet")).alias("named"),
    )


@query
def scan_filter_after_schema_change(spark, d):
    return fx.evolved(spark, d).scan("o_totalprice > 100000 AND o_orderkey < 8000")


@query
def scan_old_schema(spark, d):
    ds = fx.evolved(spark, d)
    return ds.scan("o_custkey < 500", snapshot_id=ds.snapshots()[0].snapshot_id)


@query
def scan_all_versions_after_schema_change(spark, d):
    return fx.evolved(spark, d).scan_all_versions()


@query
def scan_multi_snapshot_distinct(spark, d):
    return fx.history(spark, d).scan_all_versions()


# --- commits ----------------------------------------------------------------------


@query
def overwrite_scan(spark, d):
    ds = fx.history(spark, d)
    return ds.scan(snapshot_id=ds.snapshots()[2].snapshot_id)


@query
def append_after_truncate_scan(spark, d):
    return fx.history(spark, d).scan()


@query
def add_files_scan(spark, d):
    return fx.added(spark, d).scan()


@query
def add_files_dedup(spark, d):
    s = fx.registered(spark, d).snapshot()
    return _rows(spark, [(s.sequence_number, s.summary["added-data-files"], s.summary["total-data-files"], s.summary["total-records"])], "commits int, added long, files long, records long")


@query
def truncate_and_add_scan(spark, d):
    return fx.registered(spark, d).scan()


@query
def truncate_summary(spark, d):
    s = fx.history(spark, d).snapshots()[4]
    keys = ("added-data-files", "deleted-data-files", "total-data-files", "deleted-records", "total-records", "total-data-size")
    return _rows(spark, [tuple(s.summary[k] for k in keys)], "added_files long, deleted_files long, total_files long, deleted_records long, total_records long, total_data_size long")


@query
def truncate_scan_count(spark, d):
    ds = fx.history(spark, d)
    return ds.scan(snapshot_id=ds.snapshots()[4].snapshot_id).agg(F.count("*").alias("n"))


@query
def refresh_totals(spark, d):
    before, s = fx.history(spark, d).snapshots()[2:4]
    same = s.timestamp_ms == before.timestamp_ms and s.commit_message == before.commit_message
    return _rows(
        spark, [(s.operation_type, s.user_created, same, s.agent["agent-committer"], s.summary["total-records"], s.summary["total-data-files"])],
        "operation string, user_created boolean, keeps_message boolean, agent string, records long, files long",
    )


@query
def snapshot_log(spark, d):
    s = lambda k: F.col("summary")[k]
    return fx.history(spark, d).snapshot_log().select(
        F.col("sequence_number").cast("int").alias("sequence_number"), "operation_type", "author", "commit_message", s("added-records").alias("added_records"),
        s("deleted-records").alias("deleted_records"), s("total-records").alias("total_records"), s("total-data-files").alias("total_files"),
        F.col("manifest").isNotNull().alias("has_manifest"),
    )


@query
def stream_append_scan(spark, d):
    ds = fx.new_catalog(spark).create_dataset("sales.stream", fx.table(spark, d, "orders").schema, author="loader")
    stream = spark.readStream.schema(ds.schema()).option("pathGlobFilter", "orders.parquet").parquet(d)
    append_stream(stream, ds, "streamer", f"{ds.location}/checkpoint").awaitTermination()
    return ds.refresh().scan()


# --- manifests --------------------------------------------------------------------


def _labelled(ds: Dataset, column: str) -> DataFrame:
    """Per-column statistics with the file's only value of ``column`` as label."""
    i = ds.schema().names.index(column)
    labels = ds.manifest().select("file_path", F.get("min_values_display", F.lit(i)).alias("label"))
    return mf.per_column(ds.manifest(), ds.schema().names).join(labels, "file_path")


@query
def manifest_record_counts(spark, d):
    return fx.orders(spark, d).manifest().select(F.get("min_values_display", F.lit(2)).alias("status"), "record_count")


@query
def manifest_null_counts(spark, d):
    return _labelled(fx.events(spark, d), "event_type").select("label", "column", "nulls")


@query
def manifest_minmax(spark, d):
    return _labelled(fx.orders(spark, d), "o_orderstatus").select("label", "column", F.col("low").alias("lo"), F.col("high").alias("hi"))


@query
def manifest_display(spark, d):
    return _labelled(fx.customers(spark, d), "c_mktsegment").filter("column IN ('c_custkey', 'c_name')").select("label", "column", F.col("low_display").alias("lo"), F.col("high_display").alias("hi"))


@query
def manifest_bytes(spark, d):
    return _labelled(fx.orders(spark, d), "o_orderstatus").select("label", "column", "bytes")


@query
def kmv_sketch(spark, d):
    s = kmv.sketch(fx.table(spark, d, "customer"), "c_custkey", method="md5")
    return s.select(F.explode(F.col("hashes").cast("array<string>")).alias("hash"))


@query
def kmv_merge(spark, d):
    parts = kmv.sketch(fx.table(spark, d, "orders"), "o_custkey", ["o_orderstatus"], "md5")
    return kmv.merge(parts).select(F.explode(F.col("hashes").cast("array<string>")).alias("hash"))


@query
def kmv_cardinality(spark, d):
    return fx.orders(spark, d).describe().select("column", "cardinality", "cardinality_is_exact")


@query
def column_histogram(spark, d):
    rows = _labelled(fx.orders(spark, d), "o_orderstatus").filter("column IN ('o_orderkey', 'o_custkey')")
    return rows.select("label", "column", F.posexplode("bins").alias("bin", "n"))


@query
def bool_histogram(spark, d):
    rows = _labelled(fx.events(spark, d), "event_type").filter("column = 'big'")
    return rows.select("label", F.coalesce(F.get("bins", F.lit(0)), F.lit(0)).cast("long").alias("yes"), F.coalesce(F.get("bins", F.lit(1)), F.lit(0)).cast("long").alias("no"))


@query
def manifest_verify(spark, d):
    ds = fx.orders(spark, d)
    wrong = ds.manifest().withColumn("null_counts", F.transform("null_counts", lambda x, i: F.when((i == 1) & (F.get("min_values_display", F.lit(2)) == "O"), F.lit(7)).otherwise(x)))
    return ins.verify_manifest(ds, stored=wrong).select("column", "field", "stored", "recomputed")


@query
def manifest_verify_clean_count(spark, d):
    return ins.verify_manifest(fx.customers(spark, d)).agg(F.count("*").alias("n"))


@query
def manifest_find_file(spark, d):
    ds = fx.history(spark, d)
    first = ds.manifest(ds.snapshots()[0].snapshot_id).select("file_path").first()[0]
    return ins.find_file(ds, first).select("record_count", F.size("null_counts").alias("columns"))


@query
def manifest_entry_json(spark, d):
    entries = ins.entry_json(fx.orders(spark, d).manifest())
    return entries.select(F.get_json_object("entry", "$.min_values_display[2]").alias("status"), F.get_json_object("entry", "$.record_count").cast("long").alias("record_count"))


@query
def column_byte_totals(spark, d):
    return ins.column_bytes(fx.orders(spark, d))


# --- profiles ---------------------------------------------------------------------


@query
def describe_orders(spark, d):
    return fx.orders(spark, d).describe().select("dataset", "column", "row_count", "min", "max", "null_count", "uncompressed_bytes")


@query
def describe_events(spark, d):
    return fx.events(spark, d).describe().select("column", "row_count", "min", "max", "null_count")


@query
def describe_after_schema_change(spark, d):
    return fx.evolved(spark, d).describe().select("column", "row_count", "min", "max", "null_count")


@query
def describe_text_columns(spark, d):
    return fx.customers(spark, d).describe().select("column", "min_display", "max_display")


@query
def describe_distribution(spark, d):
    rows = fx.orders(spark, d).describe(bins=8).filter("column IN ('o_orderkey', 'o_custkey')")
    return rows.select("column", F.posexplode("distribution").alias("bin", "n"))


# --- sketches ---------------------------------------------------------------------

_SKETCHED = ("l_quantity", "l_discount", "l_tax")


def _sketches(spark, d) -> DataFrame:
    """(col, h): a sketch of each of three columns, in one pass each."""
    li = fx.table(spark, d, "lineitem")
    out = None
    for c in _SKETCHED:
        one = dg.sketch(li, c).select(F.lit(c).alias("col"), F.col("sketch").alias("h"))
        out = one if out is None else out.unionByName(one)
    return out


def _asked(spark, d, **columns: Column) -> DataFrame:
    return _sketches(spark, d).select("col", *[F.round(c, 9).alias(k) if k != "n" else c.alias(k) for k, c in columns.items()])



@query
def distogram_bins(spark, d):
    return _sketches(spark, d).select("col", F.explode("h.bins").alias("b")).select("col", F.round("b.v", 6).alias("v"), F.col("b.f").cast("long").alias("f"))


@query
def distogram_count(spark, d):
    return _sketches(spark, d).select("col", dg.count(F.col("h")).cast("long").alias("n"), dg.bin_count(F.col("h")).alias("bins"))


@query
def distogram_bounds(spark, d):
    return _asked(spark, d, lo=F.col("h.min"), hi=F.col("h.max"))


@query
def distogram_mean(spark, d):
    return _asked(spark, d, mean=dg.mean(F.col("h")))


@query
def distogram_variance(spark, d):
    return _asked(spark, d, variance=dg.variance(F.col("h")))


@query
def distogram_stddev(spark, d):
    return _asked(spark, d, stddev=dg.stddev(F.col("h")))


@query
def distogram_count_up_to(spark, d):
    at = F.array(*[F.lit(float(x)) for x in (0.0, 0.025, 0.055, 0.1, 1.0, 17.5, 33.25, 50.0, 60.0)])
    return _sketches(spark, d).select("col", "h", F.explode(at).alias("x")).select("col", "x", F.round(dg.count_up_to(F.col("h"), F.col("x")), 6).alias("n_up_to"))


@query
def distogram_bin_size(spark, d):
    return _asked(spark, d, size=dg.bin_size(F.col("h"), 0.035))


@query
def distogram_quantile(spark, d):
    at = F.array(*[F.lit(float(q)) for q in (0.0, 0.005, 0.25, 0.5, 0.9, 0.999, 1.0, 1.5)])
    return _sketches(spark, d).select("col", "h", F.explode(at).alias("q")).select("col", "q", F.round(dg.quantile(F.col("h"), F.col("q")), 6).alias("value"))


@query
def distogram_histogram(spark, d):
    parts = _sketches(spark, d).select("col", F.posexplode(dg.histogram(F.col("h"), 5)).alias("bin", "p"))
    return parts.select("col", "bin", F.round("p.lo", 6).alias("lo"), F.round("p.hi", 6).alias("hi"), F.round("p.count", 4).alias("n"))


@query
def distogram_density(spark, d):
    parts = _sketches(spark, d).select("col", F.explode(dg.density(F.col("h"))).alias("p"))
    return parts.select("col", F.round("p.lo", 6).alias("lo"), F.round("p.density", 4).alias("density"))


@query
def distogram_grouped(spark, d):
    s = dg.sketch(fx.table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return s.select("l_returnflag", dg.count(F.col("sketch")).cast("long").alias("n"), F.round(dg.mean(F.col("sketch")), 9).alias("mean"))


@query
def distogram_merge(spark, d):
    s = dg.merge_sketches(dg.sketch(fx.table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]))
    return s.select(F.explode("sketch.bins").alias("b")).select(F.round("b.v", 6).alias("v"), F.col("b.f").cast("long").alias("f"))


@query
def distogram_roundtrip(spark, d):
    back = _sketches(spark, d).select("col", dg.loads(dg.dumps(F.col("h"))).alias("h"))
    return back.select("col", dg.count(F.col("h")).cast("long").alias("n"), F.round(dg.quantile(F.col("h"), 0.5), 6).alias("median"))


@query
def distogram_high_cardinality(spark, d):
    s = dg.sketch(fx.table(spark, d, "lineitem"), "l_extendedprice")
    h = F.col("sketch")
    return s.select(dg.count(h).cast("long").alias("n"), F.round("sketch.min", 2).alias("lo"), F.round("sketch.max", 2).alias("hi"), F.round(dg.mean(h), 7).alias("mean"), (dg.bin_count(h) <= 50).alias("bounded"))


# --- compaction -------------------------------------------------------------------


def _entries(spark, sizes, ranges=None) -> DataFrame:
    return entries_of(
        spark,
        [
            {"file_path": f"f{i}", "file_size_in_bytes": c * MB, "uncompressed_size_in_bytes": u * MB, "record_count": n,
             "min_values": [ranges[i - 1][0]] if ranges else None, "max_values": [ranges[i - 1][1]] if ranges else None}
            for i, (c, u, n) in enumerate(sizes, 1)
        ],
    )


def _planned(spark, strategy, entries) -> DataFrame:
    c = fx.new_catalog(spark)
    ds = c.create_dataset("t.stamps", spark.createDataFrame([], "timestamp long, value string").schema, author="loader", sort_orders=[0] if strategy == "performance" else None)
    p = Compactor(ds).plan(entries)
    row = (p.kind, p.reason, ",".join(p.files), p.n_bytes // MB, p.sort_column) if p else ("none", None, None, None, None)
    return _rows(spark, [row], "kind string, reason string, files string, mb long, sort_column string")


@query
def compaction_plan_brute(spark, d):
    return _planned(spark, "brute", _entries(spark, [(30, 40, 1000), (35, 50, 1200), (110, 130, 3000)]))


@query
def compaction_plan_performance(spark, d):
    return _planned(spark, "performance", _entries(spark, [(30, 40, 1000), (35, 50, 1200), (110, 130, 3000)], [(1, 100), (50, 150), (200, 300)]))


@query
def compaction_plan_performance_small(spark, d):
    return _planned(spark, "performance", _entries(spark, [(30, 40, 1000), (35, 50, 1200), (110, 130, 3000)], [(1, 40), (50, 150), (200, 300)]))


@query
def compaction_plan_split(spark, d):
    return _planned(spark, "brute", _entries(spark, [(180, 200, 5000)]))


@query
def compaction_plan_none(spark, d):
    return _planned(spark, "brute", _entries(spark, [(100, 110, 2000), (120, 135, 2500)]))


@query
def compaction_stats(spark, d):
    entries = _entries(spark, [(30, 40, 1000), (35, 50, 1200), (110, 130, 3000), (180, 200, 5000)])
    ds = fx.new_catalog(spark).create_dataset("t.stamps", spark.createDataFrame([], "timestamp long").schema, author="loader")
    return Compactor(ds).stats(entries).withColumn("rows_per_part", F.lit(rows_per_part(200 * MB, 5000, 128 * MB)).cast("long"))


@fx.once
def _compacted(spark, d) -> Dataset:
    ds = fx.commits_of(fx.new_catalog(spark), "sales.compacted", fx.by_segment(spark, d), sort_orders=["c_custkey"])
    total = ds.snapshot().summary["total-data-size"]
    unit = total // 4
    Compactor(ds, policy=Policy(target=unit, low=unit * 3 // 4, high=unit * 5 // 4, small=unit // 4, large=unit * 2, max_bytes=total)).compact_all(50)
    return ds


@query
def compaction_preserves_rows(spark, d):
    return _compacted(spark, d).scan()


@query
def compaction_disjoint_ranges(spark, d):
    m = _compacted(spark, d).manifest().select(F.get("min_values", F.lit(0)).alias("lo"), F.get("max_values", F.lit(0)).alias("hi"), "record_count", "file_path")
    a, b = m.alias("a"), m.alias("b")
    overlaps = a.join(F.broadcast(b), (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & (F.col("a.file_path") < F.col("b.file_path")))
    return overlaps.agg(F.count("*").alias("overlaps")).crossJoin(m.agg(F.sum("record_count").alias("records")))


@query
def compaction_brute_run(spark, d):
    ds = fx.commits_of(fx.new_catalog(spark), "sales.brute", fx.by_segment(spark, d))
    Compactor(ds).compact_all(10)
    s = ds.snapshot()
    return _rows(spark, [(s.operation_type, s.user_created, s.summary["total-data-files"], s.summary["total-records"], ds.scan().count())], "operation string, user_created boolean, files long, records long, scanned long")


# --- scalar functions ---------------------------------------------------------------


@query
def scalar_functions(spark, d):
    rows = fx.table(spark, d, "customer").select("c_custkey", F.concat(F.encode("c_mktsegment", "UTF-8"), F.unhex(F.lit("FFFF"))).alias("raw"), F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("t"), F.concat("c_mktsegment", F.lit("."), "c_name").alias("dotted"))
    name = scalars.split_name(F.col("dotted"))
    return rows.select(
        "c_custkey", scalars.decode_bound(F.col("raw")).alias("segment"), F.round(scalars.parse_number(F.col("t")), 2).alias("balance"), scalars.parse_number(F.col("dotted")).alias("no_number"),
        name["collection"].alias("first_part"), name["name"].alias("second_part"), scalars.linspace(F.lit(0.0), F.col("c_custkey").cast("double"), 4)[2].alias("middle"),
        scalars.hex_json(F.struct(F.substring("raw", 1, 2).alias("b"), F.col("c_custkey").alias("k")), ["b"], ["k"]).alias("doc"),
    )


# --- catalog and views --------------------------------------------------------------


@query
def catalog_listing(spark, d):
    c = fx.new_catalog(spark)
    for name in ("col_a", "col_b"):
        c.create_collection(name, author="ann")
        c.create_collection_if_not_exists(name, author="ann")
    schema = fx.table(spark, d, "nation").schema
    c.create_dataset("col_a.nation", schema, author="ann")
    c.create_dataset("col_a.gone", schema, author="ann")
    c.drop_dataset("col_a.gone")
    c.create_view("col_b.v", "SELECT 1 AS one", author="ann")
    return c.listing()


@query
def dataset_exists_matrix(spark, d):
    c = fx.catalog(spark, d)
    fx.orders(spark, d)
    rows = [("sales.orders", c.dataset_exists("sales.orders")), ("sales,orders", c.dataset_exists("sales", "orders")), ("sales.none", c.dataset_exists("sales.none")), ("none.none", c.view_exists(("none", "none")))]
    try:
        c.dataset_exists("orders")
    except ValueError:
        rows.append(("orders", None))
    return _rows(spark, rows, "name string, found boolean")


@query
def catalog_errors(spark, d):
    c = fx.new_catalog(spark)
    schema = fx.table(spark, d, "nation").schema
    c.create_collection("col", author="ann")
    c.create_dataset("col.nation", schema, author="ann")
    c.create_view("col.v", "SELECT 1 AS one", author="ann")
    tries = {
        "collection again": lambda: c.create_collection("col", author="ann"),
        "dataset again": lambda: c.create_dataset("col.nation", schema, author="ann"),
        "dataset missing": lambda: c.load_dataset("col.none"),
        "dataset without author": lambda: c.create_dataset("col.other", schema),
        "view again": lambda: c.create_view("col.v", "SELECT 2 AS two", author="ann"),
        "view missing": lambda: c.load_view("col.none"),
    }
    rows = []
    for name, run in tries.items():
        try:
            run()
            rows.append((name, "none", False))
        except (errors.CatalogError, ValueError) as e:
            rows.append((name, type(e).__name__, isinstance(e, KeyError)))
    return _rows(spark, rows, "attempt string, error string, is_key_error boolean")


@query
def schema_columns(spark, d):
    schema = spark.createDataFrame([], "id bigint, tags array<string>, price decimal(12,2), at timestamp").schema
    ds = fx.new_catalog(spark).create_dataset("t.typed", schema, author="ann")
    doc = ds.schema_document(ds.doc["current-schema-id"])
    rows = [(c["id"], c["name"], c["type"], c["element-type"], c["precision"], c["scale"]) for c in doc["columns"]]
    return _rows(spark, rows, "id int, name string, type string, element_type string, precision int, scale int")


@query
def schema_versions(spark, d):
    c = fx.new_catalog(spark)
    c.create_dataset("t.typed", spark.createDataFrame([], "id bigint").schema, author="ann")
    c.set_schema("t.typed", spark.createDataFrame([], "id bigint, name string").schema, "ben")
    rows = [(v["sequence-number"], len(v["columns"]), v["author"]) for v in c.load_dataset("t.typed").schema_versions()]
    return _rows(spark, rows, "version int, columns int, author string")


@query
def dataset_metadata(spark, d):
    c = fx.new_catalog(spark)
    c.create_dataset("t.typed", spark.createDataFrame([], "id bigint").schema, author="ann")
    c.update_dataset_description("t.typed", "ids", "ben")
    c.set_maintenance_policy("t.typed", retained_snapshot_count=5)
    c.annotate("t.typed", "raw")
    ds = c.load_dataset("t.typed")
    doc = ds.doc
    row = (doc["format-version"], doc["description"], doc["describer"], doc["maintenance-policy"]["retained-snapshot-count"], ",".join(doc["annotations"]), ds.snapshot() is None, ds.next_sequence_number())
    return _rows(spark, [row], "format_version int, description string, describer string, retained int, annotations string, is_empty boolean, next_sequence int")


def _view(spark, d, name: str, sql: str) -> DataFrame:
    c = fx.catalog(spark, d)
    fx.orders(spark, d), fx.customers(spark, d)
    return c.create_view(f"reports.{name}", sql, author="ann", update_if_exists=True).to_df()


@query
def view_run(spark, d):
    return _view(spark, d, "urgent", "SELECT o_orderkey, o_totalprice FROM ws.sales.orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'sales.orders'")


@query
def view_nested(spark, d):
    _view(spark, d, "big", "SELECT o_custkey, o_totalprice FROM sales.orders WHERE o_totalprice > 100000")
    return _view(spark, d, "big_customers", "SELECT o_custkey, count(*) AS n FROM reports.big GROUP BY o_custkey")


@query
def view_versioned(spark, d):
    c = fx.new_catalog(spark)
    c.create_view("reports.v", "SELECT 1 AS one", author="ann", description="first")
    c.create_view("reports.v", "SELECT 2 AS two", author="ben", update_if_exists=True)
    v = c.load_view("reports.v")
    rows = [(s["sequence-number"], s["sql"], s["author"], v.sql == s["sql"], v.metadata["description"]) for s in v.statements()]
    return _rows(spark, rows, "version int, sql string, author string, is_current boolean, description string")


@query
def view_join_agg(spark, d):
    return _view(
        spark, d, "by_segment",
        "SELECT c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM sales.orders o JOIN sales.customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    )


@query
def view_window(spark, d):
    return _view(
        spark, d, "ranked",
        "SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM sales.customer",
    ).withColumn("place", F.col("place").cast("long"))


@query
def view_rollup(spark, d):
    return _view(spark, d, "rolled", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM sales.orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")


@query
def view_setops(spark, d):
    return _view(
        spark, d, "setops",
        "(SELECT o_custkey AS k FROM sales.orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM sales.orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM sales.orders WHERE o_orderstatus = 'P'",
    )


@query
def view_semi_anti(spark, d):
    return _view(spark, d, "idle", "SELECT c_custkey, c_name FROM sales.customer c WHERE NOT EXISTS (SELECT 1 FROM sales.orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")


@query
def view_exec_metadata(spark, d):
    c = fx.new_catalog(spark)
    df = fx.table(spark, d, "nation")
    c.create_dataset("t.nation", df.schema, author="ann").append(df.coalesce(1), "ann")
    c.create_view("t.v", "SELECT n_regionkey, count(*) AS n FROM t.nation GROUP BY n_regionkey", author="ann").run()
    c.update_view_description("t.v", "by region", "ben")
    doc = c.load_view("t.v").metadata
    return _rows(spark, [(doc["last-execution-records"], doc["last-execution-time-ms"] >= 0, doc["last-execution-ms"] > fx.BEGIN, doc["description"])], "records int, timed boolean, dated boolean, description string")


@query
def event_payloads(spark, d):
    c = fx.new_catalog(spark)
    c.create_collection("col", author="ann")
    c.create_dataset("col.nation", fx.table(spark, d, "region").schema, author="ann")
    c.create_view("col.v", "SELECT 1 AS one", author="ann")
    c.update_view_execution_metadata("col.v", 100, 1500)
    c.drop_view("col.v")
    bodies = list(c.events.sink.sent)
    bodies += [c.events.body("update", "ws", "col", "dataset", "nation", x) for x in (ev.dataset_updated("d"), ev.dataset_committed(123, 5, 1000, 2), ev.view_updated("d"), ev.dataset_deleted(), ev.view_executed(error="e"))]
    rows = []
    for i, b in enumerate(bodies):
        data = {k: v for k, v in b["data"].items() if k != "location"}
        e = b["event"]
        rows.append((i, e["action"], e["workspace"], e["collection"], e["resource_type"], e["resource_name"], e["timestamp"], json.dumps(data, sort_keys=True)))
    return _rows(spark, rows, "i int, action string, workspace string, collection string, resource_type string, resource_name string, timestamp long, data string")


@query
def workspace_bytes(spark, d):
    c = fx.catalog(spark, d)
    fx.orders(spark, d)
    return c.byte_totals().filter("dataset = 'sales.orders'")


