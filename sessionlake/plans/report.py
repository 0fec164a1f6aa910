"""Status of a memory tree, and its token usage, as small metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text as x
from sessionlake.operators import pending, usage
from sessionlake.plans import context
from sessionlake.session import Layout
from sessionlake.sources import text as files
from sessionlake.sources import transcripts


def memory_status(spark: SparkSession, layout: Layout) -> DataFrame:
    """(metric, value): notes, sessions, captured and pending counts, first and last day."""
    days = files.list_files(spark, f"{layout.daily}/*.md").agg(F.count("*").alias("daily_notes"), F.min("stem").alias("first_day"), F.max("stem").alias("last_day"))
    notes = files.list_files(spark, f"{layout.project_memory}/*.md").agg(F.count("*").alias("project_notes"))
    sessions = transcripts.list_sessions(spark, layout.projects)
    captured = files.read_ledger(spark, layout.captured)
    flagged = pending.captured_flags(sessions, captured).agg(F.count("*").alias("sessions"), F.count(F.when(F.col("captured"), True)).alias("captured"))
    todo = context.verified_pending(spark, layout).agg(F.count("*").alias("pending"), F.countDistinct("date").alias("pending_days"))
    row = days.crossJoin(notes).crossJoin(flagged).crossJoin(todo)  # frames of one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("r")).select("r.*")


def token_usage(spark: SparkSession, layout: Layout, settings: dict, cwd: str) -> DataFrame:
    """The thirteen usage figures for a working directory."""
    project = context.current_project(spark, layout, cwd, settings)
    return usage.report(context.components(spark, layout, settings, project).select("component", "text"), settings, project)


def day_sessions(spark: SparkSession, layout: Layout, day: str, preview: int = 200) -> DataFrame:
    """(session_id, file_size, captured, message_count, previews): a day's sessions and what an extract would hold.

    previews: the beginnings of the first two messages; sessions that are captured have no messages here.
    """
    sessions = transcripts.list_sessions(spark, layout.projects).where(x.session_date("created", "file_mtime") == day)
    flagged = pending.captured_flags(sessions, files.read_ledger(spark, layout.captured)).select("project_hash", "session_id", "file_size", "captured")
    cut = lambda m: F.concat(F.upper(m["role"]), F.lit(": "), F.substring(m["content"], 1, preview))
    held = context.day_extract(spark, layout, day).select("project_hash", "session_id", "message_count", F.transform(F.slice("messages", 1, 2), cut).alias("previews"))
    rows = flagged.join(held, ["project_hash", "session_id"], "left")
    return rows.select("session_id", "file_size", "captured", F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"), F.coalesce("previews", F.array().cast("array<string>")).alias("previews")).orderBy("session_id")


def compare_folders(spark: SparkSession, source: str, installed: str, pattern: str = "*") -> DataFrame:
    """(name, status): of each of source's files whether the installed copy is same, different or missing."""
    sides = []
    for path, c in ((source, "a"), (installed, "b")):
        found = files.read_bytes(spark, f"{path}/{pattern}")
        sides.append(found.select("name", F.sha2("content", 256).alias(c)))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return sides[0].join(sides[1], "name", "left").select("name", status.alias("status")).orderBy("name")
