"""Projects: index build, matching a working directory, orphaned and stale folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as x
from sessionlake.operators import prefix


def build_projects(folders: DataFrame) -> DataFrame:
    """One row for each project: canonical_path, name, original_path, encoded_paths, work_days, variations.

    folders: (project_hash, original_path, day). Paths are grouped without regard to case;
    the name comes from the least folder. Folders without a path, and projects without a
    day, are dropped. variations lists the spellings where there is more than one.
    """
    known = folders.where("original_path <> ''").withColumn("canonical_path", F.lower("original_path"))
    grouped = known.groupBy("canonical_path").agg(
        F.min_by("original_path", F.struct("project_hash", "original_path")).alias("original_path"),
        F.array_sort(F.collect_set("project_hash")).alias("encoded_paths"),
        F.array_sort(F.collect_set("day")).alias("work_days"),
        F.array_sort(F.collect_set("original_path")).alias("spellings"),
    )
    named = grouped.where(F.size("work_days") > 0).withColumn("name", x.basename("original_path"))
    return named.withColumn("variations", F.when(F.size("spellings") > 1, F.col("spellings"))).drop("spellings")


def work_days_by_file(projects: DataFrame) -> DataFrame:
    """(file, work_days) by memory file name; of names that collide the greatest path counts."""
    named = projects.where("name <> ''").withColumn("file", x.memory_filename("name"))
    return named.groupBy("file").agg(F.array_sort(F.max_by("work_days", "canonical_path")).alias("work_days"))


def project_names(projects: DataFrame) -> DataFrame:
    return projects.select("name").where("name <> ''").distinct().orderBy("name")


def match_project(paths: DataFrame, projects: DataFrame, path: str = "path", include_subdirs: bool = True) -> DataFrame:
    """Paths with the project of the longest key that they start with (or equal), inner.

    Keys are compared as plain prefixes, so a key also matches its longer siblings. Paths that
    differ in case only are matched once.
    """
    low = F.lower(F.col(path))
    if not include_subdirs:
        return paths.withColumn("canonical_path", low).join(projects, "canonical_path")
    found = prefix.longest_prefix(paths.select(low.alias("s")), projects.select(F.col("canonical_path").alias("key")))
    hits = paths.select(path).distinct().withColumn("s", low).join(found, "s").select(path, F.col("key").alias("canonical_path"))
    return hits.join(projects, "canonical_path")


def orphans(folders: DataFrame, projects: DataFrame, existing: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Folders that no project lists and whose path is missing, with file count and size.

    folders: (project_hash, original_path); existing: (path) that exist; files: (project_hash, size).
    """
    listed = projects.select(F.explode("encoded_paths").alias("project_hash")).distinct()
    lost = folders.join(listed, "project_hash", "left_anti").join(existing.select(F.col("path").alias("original_path")), "original_path", "left_anti")
    if files is None:
        return lost
    sizes = files.groupBy("project_hash").agg(F.count("*").alias("file_count"), F.sum("size").cast("bigint").alias("bytes"))
    return lost.join(sizes, "project_hash", "left").fillna(0, ["file_count", "bytes"])


def stale(projects: DataFrame, existing: DataFrame) -> DataFrame:
    """Projects whose path does not exist."""
    return projects.join(existing.select(F.col("path").alias("original_path")), "original_path", "left_anti")


def statuses(projects: DataFrame, existing: DataFrame, memory_files: DataFrame) -> DataFrame:
    """Projects with path_exists, has_memory_file and issues. memory_files: (file)."""
    there = existing.select(F.col("path").alias("original_path"), F.lit(True).alias("path_exists"))
    held = memory_files.select("file", F.lit(True).alias("has_memory_file"))
    rows = projects.withColumn("file", x.memory_filename("name")).join(there, "original_path", "left").join(held, "file", "left").fillna(False, ["path_exists", "has_memory_file"])
    issue = F.when(~F.col("path_exists"), F.concat(F.lit("path missing: "), "original_path"))
    return rows.withColumn("issues", F.array_compact(F.array(issue)))
