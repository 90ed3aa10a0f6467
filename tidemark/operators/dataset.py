"""Versioned datasets: commits, time travel, scans and profiles."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tidemark.errors import CommitConflict
from tidemark.operators import manifest as mf
from tidemark.operators.describe import describe
from tidemark.operators.prune import prune

RETRIES = 20
#: Parts of a manifest; a commit that would have more puts them together.
PARTS = 64
#: Frames written at once, and bytes and rows of a row group: what one task reads at least.
#: Bytes are those left by dictionaries; alone they let 3,000,000 short rows into one.
WRITERS, ROW_GROUP, GROUP_ROWS = 16, 16 << 20, 1 << 18
_SIZES = {"data-files": "files", "files-size": "size", "data-size": "data", "records": "records"}


@dataclass
class Snapshot:
    """One immutable version of a dataset."""

    snapshot_id: int
    timestamp_ms: int
    author: str
    sequence_number: int
    operation_type: str
    manifest: str | None = None
    parent_snapshot_id: int | None = None
    schema_id: str | None = None
    commit_message: str | None = None
    user_created: bool = True
    summary: dict[str, int] = field(default_factory=dict)
    agent: dict[str, str] = field(default_factory=dict)
    #: Files of the manifest, the last of them ``manifest``.
    parts: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Written:
    """Files that no snapshot has yet: their part of a manifest and its totals."""

    schema_id: str
    part: str
    sums: dict[str, int]


LOG = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("manifest", T.StringType()),
        T.StructField("parent_snapshot_id", T.LongType()),
        T.StructField("schema_id", T.StringType()),
        T.StructField("commit_message", T.StringType()),
        T.StructField("user_created", T.BooleanType()),
        T.StructField("summary", T.MapType(T.StringType(), T.LongType())),
        T.StructField("agent", T.MapType(T.StringType(), T.StringType())),
    ]
)


def totals(entries: DataFrame) -> dict[str, int]:
    """Files, their size, the size of their data and their records."""
    r = entries.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("file_size_in_bytes"), F.lit(0)).alias("size"),
        F.coalesce(F.sum("uncompressed_size_in_bytes"), F.lit(0)).alias("data"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"),
    ).first()
    return {k: int(r[k]) for k in ("files", "size", "data", "records")}


def summarize(added: dict[str, int], deleted: dict[str, int], before: dict[str, int]) -> dict[str, int]:
    """The summary of a commit; ``before`` are the totals it started from."""
    out = {}
    for name, k in _SIZES.items():
        out[f"added-{name}"], out[f"deleted-{name}"] = added[k], deleted[k]
        out[f"total-{name}"] = before[k] + added[k] - deleted[k]
    return out


_NONE = {"files": 0, "size": 0, "data": 0, "records": 0}


class Dataset:
    """A handle on a dataset of a catalog. Every change is a new snapshot."""

    def __init__(self, catalog, identifier: str, doc: dict[str, Any]):
        self.catalog, self.identifier, self.doc = catalog, identifier, doc
        self.spark, self.store = catalog.spark, catalog.store

    # --- metadata ---

    @property
    def location(self) -> str:
        return self.doc["location"]

    @property
    def metadata(self) -> dict[str, Any]:
        return self.doc

    def _snapshot_path(self, sequence: int) -> str:
        return f"{self.location}/snapshots/{sequence:012d}.json"

    def _load(self, sequence: int) -> Snapshot:
        return Snapshot(**json.loads(self.store.read(self._snapshot_path(sequence), immutable=True)))

    def refresh(self) -> Dataset:
        """See the commits of others."""
        self.doc = self.catalog._dataset_doc(self.identifier)
        return self

    def _current_sequence(self) -> int:
        """The stored pointer, moved on over commits that didn't get to move it."""
        at = int(self.doc.get("current-sequence-number") or 0)
        while self.store.exists(self._snapshot_path(at + 1)):
            at += 1
        return at

    def next_sequence_number(self) -> int:
        return self._current_sequence() + 1

    def snapshot(self, snapshot_id: int | None = None, as_of_timestamp: int | None = None) -> Snapshot | None:
        """The current snapshot, the one of an id, or the last one not after a time
        in ms; None if there is none."""
        at = self._current_sequence()
        if snapshot_id is None and as_of_timestamp is None:
            return self._load(at) if at else None
        for sequence in range(at, 0, -1):
            s = self._load(sequence)
            if s.snapshot_id == snapshot_id or (as_of_timestamp is not None and s.timestamp_ms <= as_of_timestamp):
                return s
        return None

    def snapshots(self) -> list[Snapshot]:
        return [self._load(i) for i in range(1, self._current_sequence() + 1)]

    def snapshot_log(self) -> DataFrame:
        """All snapshots as rows."""
        return self.spark.createDataFrame([tuple(asdict(s)[f.name] for f in LOG) for s in self.snapshots()], LOG)

    def schema(self, schema_id: str | None = None) -> T.StructType:
        """The current schema, or the one of an id."""
        doc = self.schema_document(schema_id or self.doc["current-schema-id"])
        return T.StructType.fromJson(doc["struct"])

    def schema_document(self, schema_id: str) -> dict[str, Any]:
        return json.loads(self.store.read(f"{self.location}/schemas/{schema_id}.json", immutable=True))

    def schema_versions(self) -> list[dict[str, Any]]:
        """Documents of all schemas by sequence number."""
        found = [self.schema_document(n.removesuffix(".json")) for n in self.store.names(f"{self.location}/schemas")]
        return sorted(found, key=lambda d: d["sequence-number"])

    # --- reading ---

    def _resolve(self, snapshot_id: int | None, as_of_timestamp: int | None = None) -> Snapshot | None:
        s = self.snapshot(snapshot_id, as_of_timestamp)
        if s is None and (snapshot_id is not None or as_of_timestamp is not None):
            return None
        return s

    def _known(self) -> dict[str, T.StructType]:
        """All schemas by id; none if there never was another."""
        docs = self.schema_versions()
        return {d["schema-id"]: T.StructType.fromJson(d["struct"]) for d in docs} if len(docs) > 1 else {}

    def entries(self, s: Snapshot | None, schema: T.StructType | None = None, filled: bool = False) -> DataFrame:
        """Manifest entries of a snapshot; with a schema, statistics are in its order."""
        raw = mf.read_manifest(self.spark, *(s.parts or [s.manifest])) if s and s.manifest else mf.read_manifest(self.spark)
        return raw if schema is None else mf.aligned(raw, schema, self._known(), filled)

    def manifest(self, snapshot_id: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Manifest entries of a snapshot, in the order of its columns or of ``schema``."""
        s = self._resolve(snapshot_id)
        return self.entries(s, schema or self._schema_of(s))

    def scan_files(self, row_filter: Column | str | None = None, snapshot_id: int | None = None, as_of_timestamp: int | None = None) -> DataFrame:
        """Manifest entries of the files that a scan would read; absent numbers and
        lists are 0 and empty."""
        s = self._resolve(snapshot_id, as_of_timestamp)
        kept = prune(self.entries(s, self._schema_of(s)), self._schema_of(s), row_filter)
        return kept.select(
            *[
                F.coalesce(F.col(f.name), F.lit(0) if isinstance(f.dataType, (T.LongType, T.IntegerType)) else F.array().cast(f.dataType)).alias(f.name)
                if not isinstance(f.dataType, T.StringType)
                else F.col(f.name)
                for f in mf.SCHEMA
            ]
        )

    def _schema_of(self, s: Snapshot | None) -> T.StructType:
        return self.schema(s.schema_id if s else None)

    def scan(
        self,
        row_filter: Column | str | None = None,
        snapshot_id: int | None = None,
        row_limit: int | None = None,
        columns: list[str] | None = None,
        as_of_timestamp: int | None = None,
    ) -> DataFrame:
        """Rows of a snapshot. Files that can't match are not opened; the filter and
        the columns reach the Parquet reader. The files are fixed when it is called."""
        s = self._resolve(snapshot_id, as_of_timestamp)
        schema = self._schema_of(s)
        entries = prune(self.entries(s, schema), schema, row_filter)
        df = mf.read_entries(self.spark, schema, entries, self._known())
        if row_filter is not None:
            df = df.filter(row_filter)
        if columns is not None:
            df = df.select(*columns)
        return df if row_limit is None else df.limit(row_limit)

    def read(self, files: list[str]) -> DataFrame:
        """Rows of some files of the current snapshot, in the current schema."""
        wanted = self.spark.createDataFrame([(f,) for f in files], "file_path string")
        return mf.read_entries(self.spark, self.schema(), self.entries(self.snapshot()).join(wanted, "file_path", "left_semi"), self._known())

    def scan_all_versions(self) -> DataFrame:
        """Rows of every file that any snapshot has, each file once, in the current
        schema: a column that a file was written without is null."""
        parts = dict.fromkeys(p for s in self.snapshots() if s.manifest for p in s.parts or [s.manifest])
        entries = mf.read_manifest(self.spark, *parts).dropDuplicates(["file_path"])
        return mf.read_entries(self.spark, self.schema(), entries, self._known())

    def describe(self, snapshot_id: int | None = None, bins: int = 10) -> DataFrame:
        """One row a column, from the manifest alone; ValueError without one."""
        s = self._resolve(snapshot_id)
        if s is None or not s.manifest:
            raise ValueError(f"{self.identifier} has no manifest to describe")
        schema = self._schema_of(s)
        return describe(self.entries(s, schema, filled=True), schema, self.identifier, self.doc.get("description"), bins)

    # --- writing ---

    def _check(self, df: DataFrame, author: str | None) -> None:
        if not author:
            raise ValueError("an author is needed")
        if not isinstance(getattr(df, "schema", None), T.StructType):
            raise TypeError("a DataFrame is needed")
        want = [(f.name, f.dataType) for f in self.schema()]
        if [(f.name, f.dataType) for f in df.schema] != want:
            raise ValueError(f"columns {df.schema.simpleString()} are not those of {self.identifier}: {self.schema().simpleString()}")

    def _write(self, df: DataFrame) -> list[str]:
        """Write data files and return their paths."""
        folder = f"{self.location}/data/{uuid.uuid4().hex}"
        limits = {"parquet.block.size": ROW_GROUP, "parquet.block.row.count.limit": GROUP_ROWS}
        df.write.options(compression="zstd", **limits).parquet(folder)
        return sorted(map(unquote, self.spark.read.schema(df.schema).parquet(folder).inputFiles()))

    def write_each(self, frames: list[DataFrame], author: str) -> list[Written]:
        """Write the rows of each frame to files of its own, side by side, and measure the
        files of all together. ``append`` and ``overwrite`` take each in place of a frame."""
        for df in frames:
            self._check(df, author)
        if not frames:
            return []
        with ThreadPoolExecutor(WRITERS) as pool:
            files = list(pool.map(inheritable_thread_target(self.spark)(self._write), frames))
        sizes: dict[str, dict[str, int]] = {}
        entries = self._measured([f for fs in files for f in fs], sizes)
        path = f"{self.location}/metadata/part-{uuid.uuid4().hex}.parquet"
        mf.write_manifest(entries, path, sum(map(len, files)), F.element_at(F.split("file_path", "/"), -2))
        out = []
        for fs in files:
            of = fs[0].rsplit("/", 2)[1] if fs else None
            own = [t for f, t in sizes.items() if f.rsplit("/", 2)[1] == of]
            part = f"{path}/{mf.GROUP}={of}" if own else self._part(mf.read_manifest(self.spark), 0)
            out.append(Written(self.doc["current-schema-id"], part, {k: sum(t[k] for t in own) for k in _NONE}))
        return out

    def _new(self, df: DataFrame | Written, author: str | None) -> tuple[str, dict[str, int]]:
        """The part of a manifest and the totals of rows to be committed."""
        if not isinstance(df, Written):
            self._check(df, author)
            return self._statistics(self._write(df))
        if not author:
            raise ValueError("an author is needed")
        if df.schema_id != self.doc["current-schema-id"]:
            raise ValueError(f"{self.identifier}: the schema changed since the files were written")
        return df.part, df.sums

    def _measured(self, paths: list[str], sizes: dict[str, dict[str, int]]) -> DataFrame:
        method = self.doc.get("properties", {}).get("sketch-hash", "xxhash64")
        return mf.file_statistics(self.spark, paths, self.schema(), method, self.doc["current-schema-id"], sizes)

    def _statistics(self, paths: list[str]) -> tuple[str, dict[str, int]]:
        """Measure new files: a part of a manifest and its totals."""
        sizes: dict[str, dict[str, int]] = {}
        part = self._part(self._measured(paths, sizes), len(paths))
        return part, {k: sum(t[k] for t in sizes.values()) for k in _NONE}

    def _part(self, entries: DataFrame, n: int) -> str:
        path = f"{self.location}/metadata/part-{uuid.uuid4().hex}.parquet"
        mf.write_manifest(entries, path, n)
        return path

    @staticmethod
    def _parts(s: Snapshot | None) -> list[str]:
        return (s.parts or [s.manifest]) if s and s.manifest else []

    def _commit(self, operation: str, author: str, message: str | None, build, retry: bool, **more) -> Snapshot:
        """Make the next snapshot. ``build(previous)`` gives the parts of its manifest
        (None: no manifest) and its summary; it runs again if another commit came
        between. Parts never change; what a commit adds is one more."""
        for _ in range(RETRIES):
            last = self.snapshot()
            parts, summary = build(last)
            if parts and len(parts) > PARTS:
                parts = [self._part(mf.read_manifest(self.spark, *parts), summary["total-data-files"])]
            now = self.catalog.clock()
            ident = max(now, last.snapshot_id + 1 if last else 0)
            s = Snapshot(
                ident, more.pop("timestamp_ms", None) or ident, author, (last.sequence_number if last else 0) + 1, operation, parts[-1] if parts else None,
                last.snapshot_id if last else None, self.doc["current-schema-id"], message, summary=summary, parts=parts or [], **more,
            )
            if self.store.create(self._snapshot_path(s.sequence_number), json.dumps(asdict(s))):
                self.doc = self.catalog._patch_dataset(
                    self.identifier,
                    {"current-sequence-number": s.sequence_number, "current-snapshot-id": s.snapshot_id, "author": author, "timestamp-ms": now},
                )
                return s
            self.refresh()
            if not retry:
                break
        raise CommitConflict(f"{self.identifier}: another writer committed first")

    @staticmethod
    def _totals(last: Snapshot | None) -> dict[str, int]:
        return {k: last.summary[f"total-{n}"] for n, k in _SIZES.items()} if last else dict(_NONE)

    def _replace(self, operation: str, author: str, message: str, new: tuple[str, dict[str, int]]) -> Snapshot:
        def build(last):
            before = self._totals(last)
            return [new[0]], summarize(new[1], before, before)

        return self._commit(operation, author, message, build, retry=False)

    def append(self, df: DataFrame | Written, author: str, commit_message: str | None = None) -> Snapshot:
        """Add rows. Concurrent appends are retried on top of each other."""
        new, added = self._new(df, author)

        def build(last):
            return [*self._parts(last), new], summarize(added, _NONE, self._totals(last))

        return self._commit("append", author, commit_message or f"commit by {author}", build, retry=True)

    def overwrite(self, df: DataFrame | Written, author: str, commit_message: str | None = None) -> Snapshot:
        """Replace all rows; the files of older snapshots stay for time travel."""
        return self._replace("overwrite", author, commit_message or f"overwrite by {author}", self._new(df, author))

    def _registered(self, files: list[str]) -> list[str]:
        """Distinct Parquet files of the list, with blank and other names skipped."""
        names = [f.strip() for f in files if f and f.strip()]
        return list(dict.fromkeys(self._qualified(f) for f in names if f.lower().endswith(".parquet")))

    def _qualified(self, path: str) -> str:
        """The path as manifests have it."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()

    def add_files(self, files: list[str], author: str, commit_message: str | None = None) -> Snapshot:
        """Register existing Parquet files that the manifest doesn't have yet."""
        if not author:
            raise ValueError("an author is needed")
        wanted = self.spark.createDataFrame([(f,) for f in self._registered(files)], "file_path string")
        base = self.snapshot()
        fresh = [r[0] for r in wanted.join(self.entries(base).select("file_path"), "file_path", "left_anti").collect()]
        new, sums = self._statistics(fresh)

        def build(last):
            if (last and last.snapshot_id) == (base and base.snapshot_id):
                return [*self._parts(last), new], summarize(sums, _NONE, self._totals(last))
            added = mf.read_manifest(self.spark, new).join(self.entries(last).select("file_path"), "file_path", "left_anti")
            part = self._part(added, len(fresh))
            return [*self._parts(last), part], summarize(totals(mf.read_manifest(self.spark, part)), _NONE, self._totals(last))

        return self._commit("add-files", author, commit_message or f"add files by {author}", build, retry=True)

    def truncate_and_add_files(self, files: list[str], author: str, commit_message: str | None = None) -> Snapshot:
        """Make exactly these Parquet files the dataset; no object is deleted."""
        if not author:
            raise ValueError("an author is needed")
        new = self._statistics(self._registered(files))
        return self._replace("truncate-and-add-files", author, commit_message or f"truncate and add files by {author}", new)

    def truncate(self, author: str, commit_message: str | None = None) -> Snapshot:
        """Drop all rows from the current version; no object is deleted."""
        if not author:
            raise ValueError("an author is needed")

        def build(last):
            before = self._totals(last)
            return None, summarize(_NONE, before, before)

        return self._commit("truncate", author, commit_message or f"truncate by {author}", build, retry=False)

    def refresh_manifest(self, agent: str, author: str | None = None) -> int:
        """Measure all files again; returns the id of the new snapshot. The entry of
        a file that can't be read is kept."""
        last = self.snapshot()
        if last is None or not last.manifest:
            raise ValueError(f"{self.identifier} has no manifest to refresh")
        old = self.entries(last)
        paths = [r[0] for r in old.select("file_path").collect()]
        there = [p for p in paths if self.store.exists(p)]
        new = mf.read_manifest(self.spark, self._statistics(there)[0])
        part = self._part(new.unionByName(old.join(new.select("file_path"), "file_path", "left_anti")), len(paths))
        t = totals(mf.read_manifest(self.spark, part))

        def build(previous):
            if previous.snapshot_id != last.snapshot_id:
                raise CommitConflict(f"{self.identifier}: another writer committed first")
            return [part], summarize(_NONE, _NONE, t)

        s = self._commit(
            "statistics-refresh", author or agent, last.commit_message, build, retry=False, timestamp_ms=last.timestamp_ms, user_created=False,
            agent={"agent-committer": agent},
        )
        return s.snapshot_id

    def replace_files(self, old: list[str], df: DataFrame, author: str, message: str, agent: dict[str, str], n_bytes: int) -> Snapshot:
        """Put the rows of ``df`` in place of the files ``old`` (compaction)."""
        base = self.snapshot()
        new, sums = self._statistics(self._write(df))
        gone = self.spark.createDataFrame([(f,) for f in old], "file_path string")

        def build(last):
            if last.snapshot_id != base.snapshot_id:
                raise CommitConflict(f"{self.identifier}: another writer committed first")
            entries, before = self.entries(last), self._totals(last)
            dropped = totals(entries.join(gone, "file_path", "left_semi"))
            kept = self._part(entries.join(gone, "file_path", "left_anti"), before["files"])
            return [kept, new], summarize(sums, dropped, before)

        return self._commit("compact", author, message, build, retry=False, user_created=False, agent=agent)
