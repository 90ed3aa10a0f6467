"""Datasets that the queries read, built once a session and input folder."""

from __future__ import annotations

import itertools
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catalog import Catalog
from tidemark.operators.dataset import Dataset
from tidemark.operators.events import Events, MemorySink
from tidemark.sources.store import FileStore
from tidemark.sources.workdir import shared_folder

BEGIN = 1_700_000_000_000
STATUSES = ("F", "O", "P")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
YEARS = tuple(range(1995, 2002))

_built: dict = {}


def once(make):
    """Keep what ``make(spark, sf_dir)`` gives for the session."""

    @wraps(make)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _built:
            _built[key] = make(spark, sf_dir)
        return _built[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_catalog(spark: SparkSession, workspace: str = "ws") -> Catalog:
    """An empty workspace with a clock that ticks a second a call."""
    clock = itertools.count(BEGIN, 1000)
    tick = lambda: next(clock)
    root = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    return Catalog(spark, root, workspace, clock=tick, events=Events(MemorySink(), lambda: BEGIN))


def split(df: DataFrame, column, values) -> list[DataFrame]:
    """The rows of each of some distinct values of an expression, each in one partition,
    and last, if there are any, those of null or any other value. All tasks take part in
    one pass over ``df``; who reads a part later reads its rows only."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/split-{uuid.uuid4().hex}"
    which, rest = F.lit(len(values)), len(values)
    for i, v in enumerate(values):
        which = F.when(column == F.lit(v), F.lit(i)).otherwise(which)
    df.withColumn("_split", which).write.option("compression", "zstd").partitionBy("_split").parquet(folder)
    found = FileStore(spark).names(folder)
    parts = [f"_split={i}" for i in range(rest + (f"_split={rest}" in found))]
    return [spark.read.schema(df.schema).parquet(f"{folder}/{p}").coalesce(1) if p in found else spark.createDataFrame([], df.schema).coalesce(1) for p in parts]


def commits_of(catalog: Catalog, name: str, parts: list[DataFrame], properties: dict | None = None, sort_orders=None) -> Dataset:
    """A dataset with one file and one commit for each part."""
    ds = catalog.create_dataset(name, parts[0].schema, properties, author="loader", sort_orders=sort_orders)
    for w in ds.write_each(parts, "loader"):
        ds.append(w, "loader")
    return ds


def commits(catalog: Catalog, name: str, df: DataFrame, column, values, properties: dict | None = None, sort_orders=None) -> Dataset:
    """A dataset with one file and one commit for each value of an expression, and
    one more for the rows of null or any other value if there are any."""
    return commits_of(catalog, name, split(df, column, values), properties, sort_orders)


@once
def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = new_catalog(spark)
    c.create_collection("sales", author="loader")
    return c


@once
def by_status(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return split(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), STATUSES)


@once
def by_segment(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return split(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), SEGMENTS)


@once
def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    return commits_of(catalog(spark, sf_dir), "sales.orders", by_status(spark, sf_dir), {"sketch-hash": "md5"})


@once
def customers(spark: SparkSession, sf_dir: str) -> Dataset:
    return commits_of(catalog(spark, sf_dir), "sales.customer", by_segment(spark, sf_dir), sort_orders=["c_custkey"])


@once
def lineitem(spark: SparkSession, sf_dir: str) -> Dataset:
    return commits(catalog(spark, sf_dir), "sales.lineitem", table(spark, sf_dir, "lineitem"), F.year("l_shipdate"), YEARS, sort_orders=["l_shipdate"])


@once
def events(spark: SparkSession, sf_dir: str) -> Dataset:
    value = F.when(F.col("event_type") != "error", F.col("value"))
    df = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", value.alias("value"), (value > 50).alias("big"))
    return commits(catalog(spark, sf_dir), "sales.events", df, F.col("event_type"), EVENT_TYPES)


@once
def history(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders: append F, append O, overwrite with P, refresh, truncate, append F."""
    f, o, p = by_status(spark, sf_dir)[:3]
    ds = new_catalog(spark).create_dataset("sales.history", f.schema, author="loader")
    first, opened, pending, again = ds.write_each([f, o, p, f], "ann")
    ds.append(first, "ann")
    ds.append(opened, "ben", "open orders")
    ds.overwrite(pending, "ann")
    ds.refresh_manifest("robot")
    ds.truncate("ann")
    ds.append(again, "ann")
    return ds


@once
def evolved(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders F, then, with a column less, a new one and another order of them, O."""
    c = new_catalog(spark)
    f, o = by_status(spark, sf_dir)[:2]
    first = f.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    then = o.select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderkey")
    ds = c.create_dataset("sales.evolved", first.schema, author="loader")
    ds.append(first, "ann")
    c.set_schema("sales.evolved", then.schema, "ben")
    ds.refresh().append(then, "ann")
    return ds


@once
def registered(spark: SparkSession, sf_dir: str) -> Dataset:
    """Customers: one segment appended, then the table's file put in its place,
    then added again along with names that don't count."""
    df = table(spark, sf_dir, "customer")
    path = f"{sf_dir}/customer.parquet"
    ds = new_catalog(spark).create_dataset("sales.registered", df.schema, author="loader")
    ds.append(by_segment(spark, sf_dir)[SEGMENTS.index("BUILDING")], "ann")
    ds.truncate_and_add_files([path, path], "ann")
    ds.add_files(["", "  ", path, path, f"{sf_dir}/notes.txt"], "ann")
    return ds


@once
def added(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders: F appended, the table's file added."""
    df = table(spark, sf_dir, "orders")
    ds = new_catalog(spark).create_dataset("sales.added", df.schema, author="loader")
    ds.append(by_status(spark, sf_dir)[0], "ann")
    ds.add_files([f"{sf_dir}/orders.parquet"], "ann")
    return ds
