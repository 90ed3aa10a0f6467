"""Small text documents and file listings on any Hadoop file system."""

from __future__ import annotations

import os
from collections import OrderedDict

from pyspark.sql import SparkSession

_CACHE = 256
#: Schemes whose ``create`` without overwriting is atomic, and those where the file
#: system has to be asked for a conditional write (it refuses if it can't).
EXCLUSIVE = {"file", "hdfs", "viewfs", "webhdfs", "ofs", "o3fs", "gs", "abfs", "abfss"}
CONDITIONAL = {"s3a", "s3"}
_CONDITIONAL = "fs.option.create.conditional.overwrite"


class FileStore:
    """Reads and writes small documents; data files go through Spark itself.

    ``create`` is exclusive and decides commits; where that can't be had it raises. Documents that never change
    (snapshots, schemas, statements) are kept in a small cache.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._kept: OrderedDict[str, str] = OrderedDict()

    def _at(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @staticmethod
    def local(path: str) -> str | None:
        """The path on this machine, if the store is a local one."""
        if path.startswith("file:"):
            return "/" + path[5:].lstrip("/")
        return None if "://" in path else path

    def exists(self, path: str) -> bool:
        if (here := self.local(path)) is not None:
            return os.path.exists(here)
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str, immutable: bool = False) -> str:
        """Text of a document; FileNotFoundError if it isn't there."""
        if immutable and path in self._kept:
            self._kept.move_to_end(path)
            return self._kept[path]
        if (here := self.local(path)) is not None:
            with open(here, encoding="utf-8") as f:
                text = f.read()
        else:
            fs, p = self._at(path)
            if not fs.exists(p):
                raise FileNotFoundError(path)
            stream = fs.open(p)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        if immutable:
            self._kept[path] = text
            if len(self._kept) > _CACHE:
                self._kept.popitem(last=False)
        return text

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a document unless one is there; False if so."""
        if (here := self.local(path)) is not None:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            try:
                fd = os.open(here, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(text)
            return True
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if scheme not in EXCLUSIVE and scheme not in CONDITIONAL:
            raise ValueError(f"{scheme}: files can't be made exclusively there, so commits could be lost")
        if fs.exists(p):
            return False
        try:
            made = fs.createFile(p).overwrite(False).recursive()
            if scheme in CONDITIONAL:
                made = made.must(_CONDITIONAL, True)
            stream = made.build()
            try:
                stream.write(bytearray(text, "utf-8"))
            finally:
                stream.close()  # an object store decides here
        except Exception as e:
            if any(w in str(e) for w in ("AlreadyExists", "PreconditionFailed", "412")):
                return False
            raise
        return True

    def replace(self, path: str, text: str) -> None:
        """Write a document in place of what was there."""
        self._kept.pop(path, None)
        if (here := self.local(path)) is not None:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            draft = f"{here}.{os.getpid()}.tmp"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(draft, here)
            return
        self._write(path, text, True)

    def delete(self, path: str) -> None:
        """Delete a document or folder; a missing one is no error."""
        self._kept = OrderedDict((k, v) for k, v in self._kept.items() if not k.startswith(path))
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """Sorted names in a folder; none if there is no folder."""
        if (here := self.local(path)) is not None:
            found = os.listdir(here) if os.path.isdir(here) else []
        else:
            fs, p = self._at(path)
            found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if not n.startswith("."))
