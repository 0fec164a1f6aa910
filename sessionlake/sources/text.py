"""Text-file sources: whole documents, numbered lines, ledgers, listings."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Text mode folds all three line ends.
LINE_END = r"\r\n|\r|\n"
_GLOB = re.compile(r"[*?\[{]")


def _load(reader: DataFrameReader, spark: SparkSession, pattern: str) -> DataFrame:
    """A pattern's files by one listing of each folder: a pattern in a file's name would make every file a path of its own, looked up and listed alone."""
    folder, _, name = pattern.rpartition("/")
    if not folder or not _GLOB.search(name) and not _GLOB.search(folder) or "}" in name.split("{")[0]:
        return reader.load(pattern)
    depth = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern).depth()
    files = reader.option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return files.where(F.size(F.split(inside, "/+")) - 1 == depth)


def read_whole(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, stem, size, mtime, value): one row for each file; none if nothing matches.

    Spark's readers pass over files whose names start with a dot or underscore, so one such
    file (ledger, archive, stamp) is read through the file system; patterns never match them.
    """
    if pattern.rsplit("/", 1)[-1][:1] in (".", "_"):
        return _read_hidden(spark, pattern)
    meta = lambda f: F.col(f"_metadata.{f}")
    try:
        files = _load(spark.read.format("text").option("wholetext", True), spark, pattern)
    except AnalysisException:
        return spark.createDataFrame([], "path string, name string, stem string, size bigint, mtime timestamp, value string")
    return files.select(meta("file_path").alias("path"), meta("file_name").alias("name"), F.regexp_replace(meta("file_name"), r"\.[^.]*$", "").alias("stem"), meta("file_size").alias("size"), meta("file_modification_time").alias("mtime"), "value")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, stem, size, mtime) of the files, from the listing: no file is opened.

    The text reader loads each file even if only metadata columns are selected; the binary
    one doesn't where its content isn't.
    """
    meta = lambda f: F.col(f"_metadata.{f}")
    try:
        files = _load(spark.read.format("binaryFile"), spark, pattern)
    except AnalysisException:
        return spark.createDataFrame([], "path string, name string, stem string, size bigint, mtime timestamp")
    return files.select(meta("file_path").alias("path"), meta("file_name").alias("name"), F.regexp_replace(meta("file_name"), r"\.[^.]*$", "").alias("stem"), meta("file_size").alias("size"), meta("file_modification_time").alias("mtime"))


def read_bytes(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, content) of small files."""
    try:
        return _load(spark.read.format("binaryFile"), spark, pattern).select(F.col("_metadata.file_name").alias("name"), "content")
    except AnalysisException:
        return spark.createDataFrame([], "name string, content binary")


def read_numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, stem, line_no, line) of files that may be large: read by splits, never whole.

    line_no rises within a file but has gaps: it is where the split begins plus the row's number
    in its partition, which holds fewer rows than a split has bytes.
    """
    if paths == []:
        return spark.createDataFrame([], "path string, name string, stem string, line_no bigint, line string")
    meta = lambda f: F.col(f"_metadata.{f}")
    try:
        lines = _load(spark.read.format("text"), spark, paths) if isinstance(paths, str) else spark.read.text(paths)
    except AnalysisException:
        return read_numbered(spark, [])
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(meta("file_path").alias("path"), meta("file_name").alias("name"), F.regexp_replace(meta("file_name"), r"\.[^.]*$", "").alias("stem"), (meta("file_block_start") + row).alias("line_no"), F.col("value").alias("line"))


def _read_hidden(spark: SparkSession, path: str) -> DataFrame:
    jvm, rows = spark.sparkContext._jvm, []
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where):
        status, stream = fs.getFileStatus(where), fs.open(where)
        try:
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        name = where.getName()
        stem = name.rsplit(".", 1)[0] or name
        rows.append((path, name, stem, status.getLen(), datetime.fromtimestamp(status.getModificationTime() / 1000, UTC), data.decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, name string, stem string, size bigint, mtime timestamp, value string")


def to_lines(files: DataFrame, *keys: str, text: str = "value") -> DataFrame:
    """The keys, line_no (from 0) and line of every document."""
    return files.select(*keys, F.posexplode(F.split(F.col(text), LINE_END)).alias("line_no", "line"))


def join_lines(order: Column, line: Column) -> Column:
    """An aggregate that puts a document's lines together again in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")


def read_document(spark: SparkSession, path: str) -> str | None:
    """One small file's text on the driver, or None if it is missing."""
    row = read_whole(spark, path).select("value").first()
    return row[0] if row else None


def document_size(spark: SparkSession, path: str, component: str) -> DataFrame:
    """(component, text, bytes) of a note; no text and 0 bytes if it is missing."""
    blank = spark.createDataFrame([(component,)], "component string")
    found = read_whole(spark, path).select(F.lit(component).alias("component"), "value")
    return blank.join(found, "component", "left").select("component", F.coalesce("value", F.lit("")).alias("text"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint").alias("bytes"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(session_id): the distinct non-blank lines, trimmed."""
    lines = to_lines(read_whole(spark, path), "path").select(F.btrim("line", F.lit(" \t\x0b\f")).alias("session_id"))
    return lines.where("session_id <> ''").distinct()


def read_daily(spark: SparkSession, daily: str) -> DataFrame:
    """(day, line_no, line) of all daily notes."""
    return to_lines(read_whole(spark, f"{daily}/*.md").withColumnRenamed("stem", "day"), "day")


def read_notes(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, line_no, line) of long-term notes."""
    return to_lines(read_whole(spark, pattern).withColumnRenamed("name", "file"), "file")


def list_backups(spark: SparkSession, backups: str) -> DataFrame:
    """(backup, files): the backup folders, newest name first, with their files' names."""
    parts = F.split("path", "/")
    return list_files(spark, f"{backups}/*/*").select(F.element_at(parts, -2).alias("backup"), F.element_at(parts, -1).alias("f")).groupBy("backup").agg(F.array_sort(F.collect_list("f")).alias("files")).orderBy(F.desc("backup"))
