"""Literal rewriting of files of any size by the executors.

A file is cut into byte ranges, and a range takes the lines that start in it, so matches, which hold no
line end, lie in one range each and come out as str.replace has them. Ranges that follow each other go as one run of
_RUN bytes or a range, so that no file is opened or created for each of many small ranges. Only files that hold the old
text are written: their runs go to parts beside them, of files of one run in the pass that counts, then one task for each file
puts its parts together in order and renames the result into place, so a reader sees the old or the new file. Nothing but
paths, sizes and counts passes through the driver. A run that is repeated after a failure does what is left; only
where the new text holds the old one would it replace again what was finished.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.sources import growing

_WRITE = _RUN = 4 << 20
#: The least that a range is read by; files of one task.
_BLOCK, _FILES = 1 << 10, 256


def changed_lines(handle, lo: int, hi: int, size: int, old: bytes, new: bytes, block: int = growing.BLOCK) -> Iterator[tuple[bytes, int]]:
    """(bytes, replacements) of each line that starts in [lo, hi) of a file of so many bytes, with its line end."""
    for start, line in growing.lines_between(handle, lo, hi, block):
        n = line.count(old)
        yield (line.replace(old, new) if n else line) + (b"\n" if start + len(line) < size else b""), n


def _tasks(rows: DataFrame, step, schema: str) -> DataFrame:
    """Rows, one a task at most, through a function from a row to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from (pa.RecordBatch.from_pylist([r]) for r in step(row))

    return rows.mapInArrow(run, schema)


def rewrite_files(spark: SparkSession, root: str, suffix: str, old: str, new: str, depth: int = 0, split: int = growing.SPLIT_BYTES) -> dict[str, int]:
    """Replaces old by new in the files below root whose names end in suffix; the replacements of each file that had any, by path from root.

    depth: names from root to a file, or 0 for any. old has no line end and isn't empty. Files without
    old, empty ones and a missing root are left as they are; what isn't UTF-8 is kept byte for byte.
    """
    if not old or "\n" in old:
        raise ValueError("what is replaced must be text within a line")
    cloudpickle.register_pickle_by_value(growing)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    files = growing._Files({"path": root, "suffix": suffix, "depth": str(depth)})
    a, b, mark = old.encode(), new.encode(), uuid4().hex
    sizes = files.sizes()
    run = max(split, _RUN // split * split)
    pieces = [(p, lo, min(n, lo + run), n) for p, n in sizes.items() for lo in range(0, n, run)]
    if not pieces:
        return {}
    many, block = spark.sparkContext.defaultParallelism * 4, min(growing.BLOCK, max(split, _BLOCK))
    tasks = lambda n: min(n, max(many, n // _FILES))
    runs = spark.createDataFrame(pieces, "path string, lo bigint, hi bigint, size bigint").repartition(tasks(len(pieces)), "path", "lo")

    def cuts(row: dict) -> Iterator[tuple[int, int]]:
        for lo in range(row["lo"], row["hi"], split):
            yield lo, min(row["hi"], lo + split)

    def part(path: str, lo: int) -> str:
        folder, _, name = path.rpartition("/")
        return f"{folder}/.{name}.{mark}.{lo}".lstrip("/")

    def put(row: dict, handle) -> None:
        store, base = files.store()
        with store.open_output_stream(f"{base}/{part(row['path'], row['lo'])}", buffer_size=min(_WRITE, row["size"] + 1)) as out:
            for lo, hi in cuts(row):
                for line, _ in changed_lines(handle, lo, hi, row["size"], a, b, block):
                    out.write(line)

    def count(row: dict) -> Iterator[dict]:
        with files.open(row["path"]) as handle:
            n = sum(line.count(a) for lo, hi in cuts(row) for _, line in growing.lines_between(handle, lo, hi, block))
            if n and row["hi"] - row["lo"] == row["size"]:  # the whole file, which stays as it is until its part is renamed
                put(row, handle)
        yield {"path": row["path"], "n": n}

    def write(row: dict) -> Iterator[dict]:
        with files.open(row["path"]) as handle:
            put(row, handle)
        yield {"path": row["path"], "lo": row["lo"]}

    def join(row: dict) -> Iterator[dict]:
        store, base = files.store()
        whole, parts = f"{base}/{part(row['path'], -1)}", [f"{base}/{part(row['path'], lo)}" for lo in sorted(row["los"])]
        target = f"{base}/{row['path']}"
        if len(parts) == 1:
            if store.get_file_info(parts[0]).type == fs.FileType.File:  # else this task has been here
                store.move(parts[0], target)
        elif all(store.get_file_info(p).type == fs.FileType.File for p in parts):
            with store.open_output_stream(whole) as out:
                for p in parts:
                    with store.open_input_stream(p) as stream:
                        while data := stream.read(_WRITE):
                            out.write(data)
            store.move(whole, target)
            for p in parts:
                store.delete_file(p)
        yield {"path": row["path"]}

    found = {r["path"]: r["n"] for r in _tasks(runs, count, "path string, n bigint").groupBy("path").agg(F.sum("n").alias("n")).where("n > 0").collect()}  # files that change
    if found:
        los = {p: list(range(0, sizes[p], run)) for p in found}
        more = [(p, lo, min(sizes[p], lo + run), sizes[p]) for p, at in los.items() if len(at) > 1 for lo in at]
        if more:
            some = spark.createDataFrame(more, "path string, lo bigint, hi bigint, size bigint").repartition(tasks(len(more)), "path", "lo")
            _tasks(some, write, "path string, lo bigint").count()
        todo = spark.createDataFrame(list(los.items()), "path string, los array<bigint>").repartition(tasks(len(los)), "path")
        _tasks(todo, join, "path string").count()
    return found
