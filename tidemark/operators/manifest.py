"""Per-file, per-column statistics and the manifest that keeps them.

Statistics of any number of files take two passes over Arrow batches, both grouped
by file. The first keeps a row a file in a task (counts, nulls, ends, sizes), the
second at most 32 hashes and 32 bins a column and file; these are merged by file.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as fc
from tidemark.functions import xx
from tidemark.functions.kmv import K
from tidemark.ship import ship

BINS = 32
#: Display values are cut to this many characters when measured and when stored.
SHOWN, STORED = 16, 32
#: Texts of up to so many bytes are digested once for all their rows in a batch.
SHORT = 64
#: Files described by one part of a manifest, and measured at once.
ROWS_A_PART, FILES = 20_000, 4096
#: Folder of a part among several that were written together.
GROUP = "of"

_U64 = T.DecimalType(20, 0)
SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_format", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("file_size_in_bytes", T.LongType()),
        T.StructField("uncompressed_size_in_bytes", T.LongType()),
        T.StructField("column_uncompressed_sizes_in_bytes", T.ArrayType(T.LongType())),
        T.StructField("null_counts", T.ArrayType(T.LongType())),
        T.StructField("min_k_hashes", T.ArrayType(T.ArrayType(_U64))),
        T.StructField("histogram_counts", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("histogram_bins", T.IntegerType()),
        T.StructField("min_values", T.ArrayType(T.LongType())),
        T.StructField("max_values", T.ArrayType(T.LongType())),
        T.StructField("min_values_display", T.ArrayType(T.StringType())),
        T.StructField("max_values_display", T.ArrayType(T.StringType())),
        T.StructField("nan_counts", T.ArrayType(T.LongType())),
        T.StructField("schema_id", T.StringType()),
    ]
)


def read_files(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """The rows of Parquet files."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


_ABSENT, _OTHER = -1, -2


def _places(old: T.StructType, new: T.StructType) -> list[int]:
    """Where ``old`` has each column of ``new``: by name, of a kind whose ordinals compare."""
    at = {f.name: (i, fc.kind(f.dataType)) for i, f in enumerate(old)}
    return [_ABSENT if f.name not in at else at[f.name][0] if at[f.name][1] == fc.kind(f.dataType) else _OTHER for f in new]


def aligned(entries: DataFrame, schema: T.StructType, known: dict[str, T.StructType], filled: bool = False) -> DataFrame:
    """The entries with the statistics of each column of ``schema`` in its place there.
    They are found by name in the schema that a file was measured with (``known``, by
    id). A column that this schema doesn't have, or has with a type of another kind,
    has no statistics; with ``filled`` one that it doesn't have counts as null."""
    moved = {i: p for i, s in known.items() if (p := _places(s, schema)) != list(range(len(s)))}
    if not moved:
        return entries

    def pick(f: T.StructField) -> Column:
        if not isinstance(f.dataType, T.ArrayType):
            return F.col(f.name)
        none = F.lit(None).cast(f.dataType.elementType)
        absent = F.col("record_count") if filled and f.name == "null_counts" else none
        out = F.col(f.name)
        for ident, places in moved.items():
            there = [F.get(f.name, F.lit(p)) if p >= 0 else absent if p == _ABSENT else none for p in places]
            out = F.when(F.col("schema_id") == ident, F.array(*there) if there else F.array().cast(f.dataType)).otherwise(out)
        return out.alias(f.name)

    return entries.select(*map(pick, SCHEMA))


def read_entries(spark: SparkSession, schema: T.StructType, entries: DataFrame, known: dict[str, T.StructType]) -> DataFrame:
    """The rows of the files of some entries. A column that a file was written without
    is null; one that it has with another type is cast."""
    if not known:
        return read_files(spark, schema, [r[0] for r in entries.select("file_path").collect()])
    groups: dict[tuple, list[str]] = {}
    for path, ident in entries.select("file_path", "schema_id").collect():
        old = {f.name: f.dataType for f in known.get(ident, schema)}
        groups.setdefault(tuple(T.StructField(f.name, old.get(f.name, f.dataType)) for f in schema), []).append(path)
    out = None
    for fields, paths in groups.items():
        part = read_files(spark, T.StructType(list(fields)), paths)
        part = part.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if g.dataType != f.dataType else F.col(f"`{f.name}`") for f, g in zip(schema, fields)])
        out = part if out is None else out.unionByName(part)
    return read_files(spark, schema, []) if out is None else out


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _by_file(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each path in the first column of a batch."""
    codes = b.column(0).dictionary_encode()
    which = np.asarray(codes.indices)
    for p, path in enumerate(codes.dictionary.to_pylist()):
        yield path, b if len(codes.dictionary) == 1 else b.filter(pa.array(which == p))


def _ends(a: pa.Array) -> tuple:
    """Least and greatest value, without NaN; dates and times as the numbers they are."""
    if pa.types.is_floating(a.type):
        v = np.asarray(a.drop_null())
        v = v[~np.isnan(v)]
        return (v.min(), v.max()) if len(v) else (None, None)
    if pa.types.is_date(a.type) or pa.types.is_timestamp(a.type):
        a = a.view(pa.int32() if pa.types.is_date(a.type) else pa.int64())
    found = pc.min_max(a)
    return found["min"].as_py(), found["max"].as_py()


def _column_of(values: list, t: pa.DataType) -> pa.Array:
    if pa.types.is_date(t) or pa.types.is_timestamp(t):
        return pa.array(values, pa.int32() if pa.types.is_date(t) else pa.int64()).view(t)
    return pa.array(values, t)


def _turns(rows: DataFrame, t: T.DataType) -> bool:
    """Whether ordinals of a type may fall where its values rise: local times are read in
    the session's time zone, which may turn clocks back."""
    return isinstance(t, T.TimestampNTZType) and rows.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00")


def _first_pass(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows, size and, for each column, nulls, NaN, ordinal range, display values and
    bytes of each file. A task gives a row for each file that it reads from; ordinals and
    texts are made of the ends of these only, where they rise with the value."""
    kinds = [fc.kind(f.dataType) for f in schema]
    picked, kept = ["_path", "_size"], ["_path string, _size long, n long"]
    for i, f in enumerate(schema):
        c, t, k = F.col(f"`c{i}`"), f.dataType, kinds[i]
        shown = {"string": "string", "binary": "binary"}.get(k, t.simpleString())
        picked.append(c.isNull().alias(f"v{i}") if k == "other" else (F.substring(c, 1, SHOWN + 1) if k in ("string", "binary") else c).alias(f"v{i}"))
        kept.append(f"nulls{i} long, nans{i} long, bytes{i} long")
        if k != "other":
            kept.append(f"low{i} {shown}, high{i} {shown}")
        if _turns(rows, t):
            picked.append(fc.ordinal(c, t).alias(f"o{i}"))
            kept.append(f"lo{i} long, hi{i} long")
        if fc.varies(t):
            picked.append(fc.value_bytes(c, t).alias(f"b{i}"))
    fields = T._parse_datatype_string(", ".join(kept))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, dict] = {}
        types: dict[str, pa.DataType] = {}

        def stretch(s: dict, lo: str, hi: str, a: pa.Array) -> None:
            types[lo] = types[hi] = a.type
            x, y = _ends(a)
            if x is not None:
                s[lo] = x if s.get(lo) is None or x < s[lo] else s[lo]
                s[hi] = y if s.get(hi) is None or y > s[hi] else s[hi]

        for b in batches:
            for path, mine in _by_file(b):
                s = state.setdefault(path, {"_path": path, "_size": mine.column("_size")[0].as_py(), "n": 0})
                s["n"] += len(mine)
                for i, k in enumerate(kinds):
                    a = mine.column(f"v{i}")
                    s[f"nulls{i}"] = s.get(f"nulls{i}", 0) + (pc.sum(a).as_py() or 0 if k == "other" else a.null_count)
                    s[f"nans{i}"] = s.get(f"nans{i}", 0) + (pc.sum(pc.is_nan(a)).as_py() or 0 if k == "float" else 0)
                    if k != "other":
                        stretch(s, f"low{i}", f"high{i}", a)
                    if f"o{i}" in mine.schema.names:
                        stretch(s, f"lo{i}", f"hi{i}", mine.column(f"o{i}"))
                    if f"b{i}" in mine.schema.names:
                        s[f"bytes{i}"] = s.get(f"bytes{i}", 0) + (pc.sum(mine.column(f"b{i}")).as_py() or 0)
        if state:
            names = fields.names
            plain = {"_path": pa.string()}
            yield pa.RecordBatch.from_arrays([_column_of([s.get(x) for s in state.values()], types.get(x, plain.get(x, pa.int64()))) for x in names], names)

    parts = rows.select(*picked).mapInArrow(partial, fields)
    total = parts.groupBy("_path").agg(
        *[
            (F.max(x) if x == "_size" else F.min(x) if x.startswith("lo") else F.max(x) if x.startswith("hi") else F.sum(x)).alias(x)
            for x in fields.names[1:]
        ]
    )
    out = [F.col("_path").alias("_raw"), _decoded(F.col("_path")).alias("_path"), "n", F.col("_size").alias("size")]
    for i, f in enumerate(schema):
        t, k, lo, hi = f.dataType, kinds[i], F.col(f"low{i}"), F.col(f"high{i}")
        none, nans = F.lit(None).cast("string"), F.col(f"nans{i}")
        shown = {"string": lambda c: fc.shortened(c, SHOWN), "binary": lambda c: fc.shortened(F.lower(F.hex(c)), SHOWN)}.get(k, lambda c: F.substring(c.cast("string"), 1, STORED))
        ranged = (F.col(f"lo{i}"), F.col(f"hi{i}")) if _turns(rows, t) else (none.cast("long"),) * 2 if k == "other" else (fc.ordinal(lo, t), fc.ordinal(hi, t))
        texts = (none, none) if k == "other" else (shown(lo), shown(hi))
        if k == "float":  # NaN is the greatest
            texts = F.when(lo.isNull() & (nans > 0), "NaN").otherwise(texts[0]), F.when(nans > 0, "NaN").otherwise(texts[1])
        named = zip(("lo", "hi", "dlo", "dhi", "bytes"), (*ranged, *texts, fc.logical_bytes(F.col("n"), F.col(f"bytes{i}"), t)))
        out += [f"nulls{i}", nans, *[c.alias(f"{x}{i}") for x, c in named]]
    return total.select(*out)


_PARTIAL = "path string, col int, hashes array<long>, bins array<long>"


def _longs(a: pa.Array, width: int) -> np.ndarray:
    """Values of ``width`` bytes each as signed big-endian numbers."""
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset :][: len(a) + 1]
    raw = np.zeros((len(a), 8), np.uint8)
    if len(a):
        raw[:, 8 - width :] = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width)
    return raw.view(">i8").ravel().astype(np.int64)


def _plain(a: pa.Array) -> np.ndarray:
    """Numbers that are there; dates and times as the numbers they are."""
    a = a.drop_null()
    return np.asarray(a.view(pa.int32() if pa.types.is_date(a.type) else pa.int64()) if pa.types.is_temporal(a.type) else a)


def _floors(v: np.ndarray) -> np.ndarray:
    """Ordinals of numbers, none for NaN; what a long can't hold is the last one it can."""
    if v.dtype.kind != "f":
        return v.astype(np.int64)
    f = np.floor(v[~np.isnan(v)].astype(np.float64))
    inside = (f >= -(2.0**63)) & (f < 2.0**63)
    return np.where(inside, np.where(inside, f, 0).astype(np.int64), np.where(f > 0, 2**63 - 1, -(2**63)))


def _digests(v: pa.Array) -> np.ndarray:
    """The first eight bytes of the md5 of the text of each distinct integer or text."""
    texts = pc.unique(v).cast(pa.string()).cast(pa.binary()).to_pylist()
    return np.frombuffer(b"".join([md5(t, usedforsecurity=False).digest()[:8] for t in texts]), ">u8").astype(np.uint64)


def _second_pass(rows: DataFrame, schema: T.StructType, ranges: dict, method: str) -> DataFrame:
    """(path, col, hashes, bins) of every file and column, merged."""
    kinds = [fc.kind(f.dataType) for f in schema]
    wide = {i for (_, i), (low, high) in ranges.items() if low != high}
    # kinds whose canonical text is that of the number they are sent as
    numbered = {i for i, f in enumerate(schema) if method == "md5" and (kinds[i] == "int" or kinds[i] == "timestamp" and not _turns(rows, f.dataType))}
    texts = {i for i, k in enumerate(kinds) if method == "md5" and k == "string"}
    picked = [F.col("_path")]
    for i, f in enumerate(schema):
        c, t, k = F.col(f"`c{i}`"), f.dataType, kinds[i]
        plain = k in ("int", "float", "date", "timestamp")  # sent once, as it is
        if plain and (method == "xxhash64" or i in wide or i in numbered):
            picked.append(c.alias(f"v{i}"))
        if k == "bool" or i in wide and (not plain or _turns(rows, t)):
            picked.append((fc.first7(c, t) if k in ("string", "binary") else fc.ordinal(c, t)).alias(f"o{i}"))
        if i in texts:
            short = F.octet_length(c) <= SHORT
            picked += [F.when(short, c).alias(f"s{i}"), F.when(~short, fc.digest8(c, t)).alias(f"h{i}")]
        elif k not in ("other", "bool") and i not in numbered and not (plain and method == "xxhash64"):
            picked.append((fc.digest8(c, t) if method == "md5" else fc.hash64(c, t, method)).alias(f"h{i}"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        numbers = lambda a, width: _longs(a, width) if pa.types.is_binary(a.type) else np.asarray(a).astype(np.int64)
        for b in batches:
            names = set(b.schema.names)
            for path, mine in _by_file(b):
                for i, k in enumerate(kinds):
                    if k == "other":
                        continue
                    hashes, bins = state.setdefault((path, i), [np.zeros(0, np.uint64), None])
                    v = _plain(mine.column(f"v{i}")) if f"v{i}" in names else None
                    if k != "bool":
                        if i in numbered:
                            h = _digests(pa.array(v))
                        else:
                            h = numbers(mine.column(f"h{i}").drop_null(), 8).view(np.uint64) if f"h{i}" in names else xx.xxhash64(v)
                        if i in texts:
                            h = np.concatenate([h, _digests(mine.column(f"s{i}").drop_null())])
                        if len(hashes) == K:
                            h = h[h < hashes[-1]]
                        if len(h):
                            h = np.asarray(pc.unique(pa.array(h)))
                            hashes = np.unique(np.concatenate([hashes, h]))[:K]
                    low, high = ranges.get((path, i), (None, None))
                    if k == "bool" or (low is not None and low != high):
                        o = numbers(mine.column(f"o{i}").drop_null(), 7) if f"o{i}" in names else _floors(v)
                        if k == "bool":
                            counts = np.array([(o == 1).sum(), (o == 0).sum()])
                        else:
                            span = float(high) - float(low)  # 0 where only digits beyond a double's differ
                            share = (o.astype(float) - float(low)) / span if span else np.zeros(len(o))
                            at = np.clip(np.floor(share * (BINS - 1)), 0, BINS - 1).astype(np.int64)
                            counts = np.bincount(at, minlength=BINS)
                        if len(o):
                            bins = counts if bins is None else bins + counts
                    state[path, i] = [hashes, bins]
        if state:
            keys, values = list(state), list(state.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([v[0].view(np.int64).tolist() for v in values], pa.list_(pa.int64())),
                    pa.array([None if v[1] is None else v[1].tolist() for v in values], pa.list_(pa.int64())),
                ],
                ["path", "col", "hashes", "bins"],
            )

    parts = rows.select(*picked).mapInArrow(partial, _PARTIAL)
    unsigned = F.transform(F.flatten(F.collect_list("hashes")), fc.unsigned)
    added = F.aggregate(
        F.filter(F.collect_list("bins"), lambda x: x.isNotNull()),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.zip_with(acc, x, lambda p, q: p + q)),
    )
    merged = parts.groupBy("path", "col").agg(F.slice(F.array_sort(F.array_distinct(unsigned)), 1, K).alias("hashes"), added.alias("bins"))
    return merged.withColumn("path", _decoded(F.col("path")))


def file_statistics(
    spark: SparkSession, paths: list[str], schema: T.StructType, method: str = "xxhash64", schema_id: str | None = None, sizes: dict[str, dict[str, int]] | None = None
) -> DataFrame:
    """A manifest entry for each of ``paths``. A file without rows has no entry.
    ``sizes`` gets the totals of each file that has one."""
    ship(spark)
    out = spark.createDataFrame([], SCHEMA) if not paths else None
    for lo in range(0, len(paths), FILES):  # bounds what the driver and a task hold
        part = _measured(spark, paths[lo : lo + FILES], schema, method, schema_id, sizes)
        out = part if out is None else out.unionByName(part)
    return out


def _measured(spark: SparkSession, paths: list[str], schema: T.StructType, method: str, schema_id: str | None, sizes: dict[str, dict[str, int]] | None) -> DataFrame:
    files = read_files(spark, schema, paths)
    rows = files.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(schema)]
    )
    measured = _first_pass(rows, schema).collect()  # one row a new file
    if sizes is not None:
        for r in measured:
            sizes[r["_path"]] = {"files": 1, "size": r["size"], "data": sum(r[f"bytes{i}"] for i in range(len(schema))), "records": r["n"]}
    ranges = {(r["_raw"], i): (r[f"lo{i}"], r[f"hi{i}"]) for r in measured for i in range(len(schema)) if r[f"lo{i}"] is not None}
    n = len(schema)
    each = lambda name, cast: (lambda r: [cast(r[f"{name}{i}"]) for i in range(n)])
    same = lambda x: x
    fields = {"bytes": same, "nulls": same, "lo": same, "hi": same, "dlo": same, "dhi": same, "nans": same}
    head = spark.createDataFrame(
        [(r["_path"], r["n"], r["size"], *[each(k, v)(r) for k, v in fields.items()]) for r in measured],
        "path string, n long, size long, bytes array<long>, nulls array<long>, mins array<long>, maxs array<long>, dlo array<string>, dhi array<string>, nans array<long>",
    )
    parts = _second_pass(rows, schema, ranges, method)
    filled = parts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("hashes", "bins")))).alias("m"))
    whole = head.join(filled, "path", "left")

    def over(field: str, kind: str) -> Column:
        none = F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
        return F.array(*[F.coalesce(F.try_element_at("m", F.lit(i))[field], none) for i in range(n)]) if n else F.array().cast(f"array<{kind}>")

    return whole.select(
        F.col("path").alias("file_path"),
        F.lit("parquet").alias("file_format"),
        F.col("n").alias("record_count"),
        F.col("size").alias("file_size_in_bytes"),
        F.aggregate("bytes", F.lit(0).cast("long"), lambda s, x: s + x).alias("uncompressed_size_in_bytes"),
        F.col("bytes").alias("column_uncompressed_sizes_in_bytes"),
        F.col("nulls").alias("null_counts"),
        over("hashes", "array<decimal(20,0)>").alias("min_k_hashes"),
        over("bins", "array<bigint>").alias("histogram_counts"),
        F.lit(BINS).alias("histogram_bins"),
        F.col("mins").alias("min_values"),
        F.col("maxs").alias("max_values"),
        F.transform("dlo", lambda c: fc.shortened(c, STORED)).alias("min_values_display"),
        F.transform("dhi", lambda c: fc.shortened(c, STORED)).alias("max_values_display"),
        F.col("nans").alias("nan_counts"),
        F.lit(schema_id).cast("string").alias("schema_id"),
    )


def write_manifest(entries: DataFrame, path: str, n_files: int, group: Column | None = None) -> None:
    """Write a manifest, in parts of ``ROWS_A_PART`` files; with ``group``, one in a
    folder ``of=`` for each of its values."""
    parts = max(1, -(-n_files // ROWS_A_PART))
    shaped = entries.select(*[F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in SCHEMA])
    if group is None:
        shaped.repartition(parts).write.option("compression", "zstd").parquet(path)
    else:
        shaped.repartition(parts).withColumn(GROUP, group).write.option("compression", "zstd").partitionBy(GROUP).parquet(path)


def read_manifest(spark: SparkSession, *parts: str) -> DataFrame:
    """The entries of a manifest of so many parts."""
    return spark.read.schema(SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], SCHEMA)


def per_column(manifest: DataFrame, names: list[str]) -> DataFrame:
    """One row a file and column: file_path, record_count, position, column and the
    column's statistics."""
    fields = {
        "column_uncompressed_sizes_in_bytes": "bytes", "null_counts": "nulls", "min_k_hashes": "hashes", "histogram_counts": "bins",
        "min_values": "low", "max_values": "high", "min_values_display": "low_display", "max_values_display": "high_display", "nan_counts": "nans",
    }
    zipped = F.arrays_zip(*[F.col(k).alias(v) for k, v in fields.items()])
    rows = manifest.select("file_path", "record_count", F.posexplode(zipped).alias("position", "s"))
    column = F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1) if names else F.lit(None).cast("string")
    return rows.filter(F.col("position") < len(names)).select(
        "file_path", "record_count", "position", column.alias("column"), *[F.col("s")[v].alias(v) for v in fields.values()]
    )
