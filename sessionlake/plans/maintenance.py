"""The two jobs that rewrite a memory tree: decay and the projects index."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text as x
from sessionlake.operators import decay, index
from sessionlake.session import Layout
from sessionlake.sources import sinks, transcripts
from sessionlake.sources import text as files


def note_work_days(spark: SparkSession, layout: Layout) -> DataFrame:
    """(file, day): the work days of every project's notes."""
    days = index.work_days_by_file(transcripts.read_projects_index(spark, layout.projects_index))
    return days.select("file", F.explode("work_days").alias("day"))


def run_decay(spark: SparkSession, layout: Layout, settings: dict, as_of: date, dry_run: bool = False, compat: bool = True) -> dict[str, int]:
    """Archives what has decayed and purges old archive sections; the numbers of both.

    The global note decays by calendar, a project's by its work days, or by calendar if it
    has none. Files that lose nothing are not touched; with dry_run none are. Every file is
    replaced as a whole, the archive before the notes, so a failure repeats entries at most.
    """
    own, today = settings["decay"], F.lit(as_of)
    lines = files.read_notes(spark, layout.global_memory).unionByName(files.read_notes(spark, f"{layout.project_memory}/*.md"))
    rows = decay.classify(lines, today, own["ageDays"], note_work_days(spark, layout), own["projectWorkingDays"], compat)
    gone = decay.archived(rows, today)
    held = decay.parse_archive(files.read_notes(spark, layout.archive))
    kept = decay.purge(held, today, own["archiveRetentionDays"])
    counts = {"archived": gone.count(), "purged": decay.purged_sections(held, today, own["archiveRetentionDays"]).count()}
    if dry_run or not any(counts.values()):
        return counts
    sections = decay.render_archive(gone).collect()  # one row: today's
    old = "\n".join(r["line"] for r in kept.where("archived_on is not null").orderBy("line_no").toLocalIterator())
    fresh = "".join(r["text"] for r in sections)
    if old.startswith(f"## Archived {as_of}\n"):
        old = old.removeprefix(f"## Archived {as_of}\n")
    changed = decay.render(rows.join(gone.select(F.col("source_file").alias("file")).distinct(), "file", "left_semi")).collect()  # only notes that lose entries
    sinks.write_document(spark, layout.archive, f"# Decay Archive\n\n{fresh}{old}".strip() + "\n")
    for r in changed:
        is_global = r["file"] == layout.global_memory.rsplit("/", 1)[-1]
        sinks.write_document(spark, layout.global_memory if is_global else f"{layout.project_memory}/{r['file']}", r["text"])
    return counts


def folder_days(spark: SparkSession, layout: Layout) -> DataFrame:
    """(project_hash, original_path, day) from session indexes and first transcript lines."""
    entries = transcripts.read_sessions_indexes(spark, layout.projects)
    first = transcripts.first_lines(spark, layout.projects)
    created = F.when(x.index_datetime("entry.created").isNotNull(), F.substring("entry.created", 1, 10))
    days = entries.select("project_hash", created.alias("day")).unionByName(first.select("project_hash", F.explode_outer("days").alias("day")))
    paths = transcripts.original_paths(entries).join(first.select("project_hash", "cwd"), "project_hash", "full")
    return paths.select("project_hash", F.coalesce("original_path", "cwd").alias("original_path")).join(days, "project_hash")


def build_index(spark: SparkSession, layout: Layout, now: datetime | None = None) -> dict:
    """The projects index as a document, saved; one entry for each project."""
    rows = index.build_projects(folder_days(spark, layout)).orderBy("canonical_path").collect()  # one row for each project folder group
    projects = {r["canonical_path"]: {"name": r["name"], "originalPath": r["original_path"], "encodedPaths": r["encoded_paths"], "workDays": r["work_days"]} for r in rows}
    doc = {"version": 1, "lastUpdated": (now or datetime.now(UTC)).isoformat(), "projects": projects, "pathVariations": {r["canonical_path"]: r["variations"] for r in rows if r["variations"]}}
    sinks.save_json(spark, layout.projects_index, doc)
    return doc
