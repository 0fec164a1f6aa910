"""Merging session indexes, rebuilding them, and sets of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def entry_id() -> Column:
    return F.coalesce("sessionId", "id")


def entry_time() -> Column:
    """What entries are ordered by, compared as strings: modified, else lastActive, else created."""
    return F.coalesce("modified", "lastActive", "created", F.lit(""))


def merge_newest(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Entries of both, one for each id, newest first, with from_source.

    A source entry replaces dest's only if strictly newer. Of repeated ids within one side
    the last by position counts in dest, the first of the newest in source. Rows without an
    id are dropped; an entry keeps all its columns. Sides: entry columns and pos.
    """
    both = source.withColumn("from_source", F.lit(True)).unionByName(dest.withColumn("from_source", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("__id", entry_id()).withColumn("__ts", entry_time()).where("__id <> ''")
    last = Window.partitionBy("__id", "from_source").orderBy(F.when(F.col("from_source"), F.col("__ts")).desc_nulls_last(), F.when(F.col("from_source"), -F.col("pos")).otherwise(F.col("pos")).desc())
    both = both.withColumn("__k", F.row_number().over(last)).where("__k = 1")
    best = Window.partitionBy("__id").orderBy(F.desc("__ts"), F.asc("from_source"))
    return both.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").orderBy(F.desc("__ts"), "__id").drop("__id", "__ts", "__k", "__rn")


def append_missing(existing: DataFrame, rebuilt: DataFrame, key: str = "sessionId") -> DataFrame:
    """existing and those rebuilt rows whose key it lacks."""
    return existing.unionByName(rebuilt.join(existing.select(key), key, "left_anti").select(*existing.columns))


def rebuild_index(files: DataFrame, lines: DataFrame, project_path: str) -> DataFrame:
    """Index entries from transcripts: files (session_id, path, mtime), lines (session_id, line_no, v).

    The first prompt is the text of the first ``human`` line, cut at 150 characters.
    """
    first = lines.where(F.try_variant_get("v", "$.type", "string") == "human").groupBy("session_id").agg(F.min_by(F.coalesce(F.try_variant_get("v", "$.message.content", "string"), F.lit("")), "line_no").alias("p"))
    prompt = F.when(F.col("p").isNull(), F.lit("(recovered session)")).when(F.col("p") == "", F.lit("(no prompt)")).otherwise(F.substring("p", 1, 150))
    stamp = F.concat(F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format("mtime", "SSSSSS") != "000000", F.date_format("mtime", ".SSSSSS")).otherwise(F.lit("")), F.lit("Z"))
    return files.join(first, "session_id", "left").select(
        F.col("session_id").alias("sessionId"), F.col("path").alias("fullPath"), F.unix_millis("mtime").alias("fileMtime"), prompt.alias("firstPrompt"), F.lit("(recovered session)").alias("summary"),
        F.lit(0).alias("messageCount"), stamp.alias("created"), stamp.alias("modified"), F.lit("").alias("gitBranch"), F.lit(project_path).alias("projectPath"), F.lit(False).alias("isSidechain"),
    ).orderBy("created", "sessionId")


def union_days(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def new_days(orphan: Column, existing: Column) -> Column:
    """Days of the orphan that the target lacks, sorted."""
    return F.array_sort(F.array_except(orphan, existing))


def rewrite_paths(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """rows with old replaced by new in a column, and n_replaced."""
    from sessionlake.functions.text import count_literal

    return rows.withColumn("n_replaced", count_literal(column, old)).withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def changed_documents(files: DataFrame, old: str, new: str) -> DataFrame:
    """Only the documents that hold old, rewritten; their number is the reported count."""
    return files.where(F.col("value").contains(old)).withColumn("value", F.replace("value", F.lit(old), F.lit(new)))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with new's rows in place of those of equal keys (null keys are equal)."""
    marked = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return existing.join(marked, same, "left_anti").unionByName(new)


def remove_containing(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column doesn't hold part; nulls stay."""
    return rows.where(~F.coalesce(F.col(column).contains(part), F.lit(False)))
