"""The file system that holds a memory tree, local or not, as one writer on the driver sees it."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from sessionlake.sources.sinks import save_json, write_document


class Store:
    """Paths are any that Spark reads. Whatever is copied keeps its time, as sessions are dated by it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def is_dir(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def writable(self, path: str) -> bool:
        fs, where = self._at(path)
        try:
            fs.access(where, self._jvm.org.apache.hadoop.fs.permission.FsAction.WRITE)
        except Exception as e:  # the JVM's
            if "AccessControl" in str(e):
                return False
            raise
        return True

    def children(self, path: str) -> list[str]:
        """Names in a folder, in order; none if it is missing."""
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str | None:
        """A small file's text, or None if it is missing or not UTF-8."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        except UnicodeDecodeError:
            return None
        finally:
            stream.close()

    def json(self, path: str, default: object) -> Any:
        try:
            return json.loads(self.read(path) or "")
        except ValueError:
            return default

    def write(self, path: str, text: str) -> bool:
        return write_document(self.spark, path, text)

    def write_json(self, path: str, value: object) -> bool:
        return save_json(self.spark, path, value)

    def copy(self, source: str, target: str, overwrite: bool = True) -> None:
        """A file, or a folder into which files go one by one; without overwrite, files that are there stay."""
        if self.is_dir(source):
            fs, where = self._at(target)
            fs.mkdirs(where)
            for name in self.children(source):
                self.copy(f"{source}/{name}", f"{target}/{name}", overwrite)
            return
        (fs, a), (other, b) = self._at(source), self._at(target)
        if overwrite or not other.exists(b):
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, self._conf)
            other.setTimes(b, fs.getFileStatus(a).getModificationTime(), -1)

    def move(self, source: str, target: str) -> None:
        """Renames; what is at the target goes first."""
        (fs, a), (_, b) = self._at(source), self._at(target)
        fs.delete(b, True)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"{source} can't be moved to {target}")

    def set_time(self, path: str, millis: int) -> None:
        fs, where = self._at(path)
        fs.setTimes(where, millis, -1)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
