"""Transcript and index sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import schemas
from sessionlake.functions import text as x
from sessionlake.sources import growing
from sessionlake.sources.text import list_files, read_numbered, read_whole


def folder(path: str = "path") -> F.Column:
    return F.element_at(F.split(F.col(path), "/"), -2)


def read_sessions_indexes(spark: SparkSession, projects: str) -> DataFrame:
    """(project_hash, original_path, pos, entry): all index entries; malformed files give none."""
    files = read_whole(spark, f"{projects}/*/sessions-index.json")
    doc = F.from_json("value", schemas.SESSIONS_INDEX)
    docs = files.where(F.try_parse_json("value").isNotNull()).select(folder().alias("project_hash"), doc.alias("d")).where("d is not null")
    path = F.coalesce(F.nullif("d.originalPath", F.lit("")), F.get("d.entries", F.lit(0))["projectPath"])
    return docs.select("project_hash", path.alias("original_path"), F.posexplode_outer("d.entries").alias("pos", "entry"))


def index_metadata(entries: DataFrame) -> DataFrame:
    """(project_hash, session_id, project_path, created, summary): the last of repeated ids."""
    known = entries.withColumn("session_id", F.coalesce("entry.sessionId", "entry.id")).where("session_id <> ''")
    last = known.groupBy("project_hash", "session_id").agg(F.max_by("entry", "pos").alias("e"))
    return last.select("project_hash", "session_id", F.col("e.projectPath").alias("project_path"), F.col("e.created").alias("created"), F.col("e.summary").alias("summary"))


def original_paths(entries: DataFrame) -> DataFrame:
    """(project_hash, original_path), without folders that name none."""
    return entries.groupBy("project_hash").agg(F.max("original_path").alias("original_path")).where("original_path <> ''")


def list_sessions(spark: SparkSession, projects: str) -> DataFrame:
    """All sessions with file facts and index metadata, newest first; subagents are left out.

    Transcripts are listed, not opened.
    """
    files = list_files(spark, f"{projects}/*/*.jsonl").where(~F.lower("stem").contains("subagent"))
    files = files.select(folder().alias("project_hash"), F.col("stem").alias("session_id"), F.col("path").alias("transcript_path"), F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"))
    meta = index_metadata(read_sessions_indexes(spark, projects))
    return files.join(meta, ["project_hash", "session_id"], "left").orderBy(F.desc("file_mtime"), "session_id", "project_hash")


def read_lines(spark: SparkSession, projects: str, paths: list[str] | None = None) -> DataFrame:
    """(project_hash, session_id, line_no, v): parsed transcript lines (variant); bad JSON is left out.

    paths: read these transcripts only. line_no gives the order of a file's lines.
    """
    lines = read_numbered(spark, f"{projects}/*/*.jsonl" if paths is None else paths)
    return lines.select(folder().alias("project_hash"), F.col("stem").alias("session_id"), "line_no", F.try_parse_json("line").alias("v")).where("v is not null")


def messages(lines: DataFrame) -> DataFrame:
    """(project_hash, session_id, line_no, role, content): what the assistant said, without noise.

    User messages, empty texts and noise are dropped; a line or message that isn't an
    object has no type and is dropped too.
    """
    kind = F.try_variant_get("v", "$.type", "string")
    rows = lines.where(kind.isin("user", "assistant")).select(
        "project_hash", "session_id", "line_no", F.coalesce(F.try_variant_get("v", "$.message.role", "string"), kind).alias("role"), x.flatten_content(F.try_variant_get("v", "$.message.content", "variant")).alias("content")
    )
    return rows.where((F.col("content") != "") & (F.col("role") != "user") & ~x.is_noise("content"))


def assistant_sessions(lines: DataFrame) -> DataFrame:
    """(project_hash, session_id) that hold any assistant line, noise included."""
    return lines.where(F.try_variant_get("v", "$.type", "string") == "assistant").select("project_hash", "session_id").distinct()


def first_lines(spark: SparkSession, projects: str) -> DataFrame:
    """(project_hash, cwd, days): from the first line of each file, in order of name; no more of a file is read than its first block.

    cwd is the first non-empty one; days are the dates of the time stamps. Subagent files count.
    """
    growing.register(spark)
    lines = spark.read.format("growing_lines").option("path", projects).option("depth", 2).option("first", True).load()
    rows = lines.select(folder().alias("project_hash"), F.element_at(F.split("path", "/"), -1).alias("name"), F.from_json("line", schemas.FIRST_LINE).alias("f"))
    day = F.when(x.index_datetime("f.timestamp").isNotNull(), F.substring("f.timestamp", 1, 10))
    cwd = F.nullif("f.cwd", F.lit(""))
    return rows.groupBy("project_hash").agg(F.min_by(cwd, F.when(cwd.isNotNull(), F.col("name"))).alias("cwd"), F.array_sort(F.collect_set(day)).alias("days"))


def read_projects_index(spark: SparkSession, path: str) -> DataFrame:
    """(canonical_path, name, original_path, encoded_paths, work_days) of the projects index."""
    docs = read_whole(spark, path).select(F.from_json("value", schemas.PROJECTS_INDEX).alias("d"))
    rows = docs.select(F.explode("d.projects").alias("canonical_path", "p"))
    empty = F.array().cast("array<string>")
    return rows.select("canonical_path", F.coalesce("p.name", F.lit("unknown")).alias("name"), F.coalesce("p.originalPath", "canonical_path").alias("original_path"), F.coalesce("p.encodedPaths", empty).alias("encoded_paths"), F.coalesce("p.workDays", empty).alias("work_days"))
