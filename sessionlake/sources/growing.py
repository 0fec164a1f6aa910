"""Transcripts that grow in place, as a data source of lines by byte range, batch or stream.

A file stream of Spark's takes a file once and never looks at what is appended to it. Here the stream's
position is how many bytes of whole lines each file has given, so an appended file gives its new
lines only, each once, also after a restart from the checkpoint. Files are read in ranges of
splitBytes: a line belongs to the range that it starts in, so ranges need no agreement and large
files are spread over tasks. A line that has no line end yet waits until it has one in a stream,
and counts in a batch. With first = true only each file's first line is read, and no more of the
file than the block that holds it.

    register(spark)
    spark.read.format("growing_lines").option("path", folder).load()
    spark.readStream.format("growing_lines").option("path", folder).load()

Rows are (path, start, line): start is the byte where the line begins, so it tells the line and
orders a file. Options: path (a folder), depth (names from there to a
file; 0: any), suffix (.jsonl), splitBytes, first.
A file that gets shorter is read again from its beginning. The position has an entry for each file, so a
stream over very many finished files should have them moved to another folder.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES, BLOCK = 64 << 20, 1 << 20
SCHEMA = "path string, start bigint, line string"
_PROBE_BLOCK = 1 << 14
_BATCH_BYTES = 4 << 20


def lines_between(handle, lo: int, hi: int, block: int = BLOCK, unfinished: bool = True) -> Iterator[tuple[int, bytes]]:
    """(start, line) of the lines of an open file that start in [lo, hi), without their line ends.

    unfinished: also a last line without an end. Reading begins a byte early, to see whether a line starts at lo.
    """
    at = max(lo - 1, 0)
    handle.seek(at)
    parts: list[bytes] = []
    begin, passing = at, lo > 0
    while data := handle.read(block):
        cut = 0
        while (end := data.find(b"\n", cut)) >= 0:
            if passing:
                passing = False
            else:
                yield begin, b"".join([*parts, data[cut:end]])
            parts, cut = [], end + 1
            begin = at + cut
            if begin >= hi:
                return
        if not passing:
            parts.append(data[cut:])
        at += len(data)
        if passing and at >= hi:
            return  # the range lies within one line
    if unfinished and not passing and any(parts) and begin < hi:
        yield begin, b"".join(parts)


def whole_lines(handle, size: int, known: int, block: int = BLOCK) -> int:
    """Bytes of a file up to its last line end, looked for backwards; known if there is none after that."""
    end = size
    while end > known:
        lo = max(known, end - block)
        handle.seek(lo)
        found = handle.read(end - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        end = lo
    return known


def ranges(sizes: dict[str, tuple[int, int]], split: int) -> list[list[tuple[str, int, int]]]:
    """The byte ranges (path, lo, hi) of files, cut at split bytes, small ones put together up to that."""
    groups: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, (lo, hi) in sorted(sizes.items()):
        for a in range(lo, hi, split):
            b = min(hi, a + split)
            if not groups or b - a > room:
                groups.append([])
                room = split
            groups[-1].append((path, a, b))
            room -= b - a
    return groups


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[tuple[str, int, int]]


class _Files:
    """The files below a folder of any file system that pyarrow opens."""

    def __init__(self, options):
        uri = options["path"]
        uri = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
        self.uri, self.suffix = uri.rstrip("/"), options.get("suffix", ".jsonl")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.first = options.get("first", "false").lower() == "true"
        self.depth = int(options.get("depth", 0))

    def store(self):
        return fs.FileSystem.from_uri(self.uri)

    def sizes(self) -> dict[str, int]:
        """Sizes by path below the folder; none if it is missing. Hidden names are passed over, as by Spark's readers."""
        store, root = self.store()
        listed = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        found = {f.path[len(root) :].lstrip("/"): f.size for f in listed if f.type == fs.FileType.File and f.path.endswith(self.suffix)}
        shown = {p: n for p, n in found.items() if not any(name[0] in "._" for name in p.split("/"))}
        return {p: n for p, n in shown.items() if self.depth in (0, p.count("/") + 1)}

    def open(self, path: str):
        store, root = self.store()
        return store.open_input_file(f"{root}/{path}")

    def rows(self, part: Ranges, unfinished: bool) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        starts: list[int] = []
        lines: list[str] = []
        size = 0
        for path, lo, hi in part.parts:
            with self.open(path) as handle:
                found = lines_between(handle, lo, hi, _PROBE_BLOCK if self.first else BLOCK, unfinished)
                for start, line in found:
                    paths.append(f"{self.uri}/{path}")
                    starts.append(start)
                    lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    size += len(line) + len(path) + 16
                    if size > _BATCH_BYTES:
                        yield _batch(paths, starts, lines)
                        paths, starts, lines, size = [], [], [], 0
                    if self.first:
                        break
        if paths:
            yield _batch(paths, starts, lines)


def _batch(paths: list[str], starts: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], names=["path", "start", "line"])


class _Batch(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[Ranges]:
        sizes = self.files.sizes()
        if self.files.first:
            # a probe costs an opening and a block, whatever the file's size
            names = sorted(p for p, n in sizes.items() if n)
            return [Ranges([(p, 0, 1) for p in names[k : k + 256]]) for k in range(0, len(names), 256)] or [Ranges([])]
        return [Ranges(g) for g in ranges({p: (0, n) for p, n in sizes.items()}, self.files.split)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition, True)


class _Stream(DataSourceStreamReader):
    """Positions are bytes of whole lines by path."""

    def __init__(self, files: _Files):
        self.files = files
        self._seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in self.files.sizes().items():
            was, whole = self._seen.get(path, (0, 0))
            if size < was:
                was = whole = 0
            if size > was:
                with self.files.open(path) as handle:
                    whole = whole_lines(handle, size, whole)
            self._seen[path] = (size, whole)
        return {p: whole for p, (_, whole) in self._seen.items() if whole}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        new = {}
        for path, hi in end.items():
            lo = start.get(path, 0)
            if hi != lo:
                new[path] = (lo if hi > lo else 0, hi)
        return [Ranges(g) for g in ranges(new, self.files.split)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition, False)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Files(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Files(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session; its code goes to the executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GrowingLines)
