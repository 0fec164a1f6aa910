"""What a session starts with: the components in order, a budget note, the prompt's data."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.functions import text as x
from sessionlake.operators import daily, index, pending
from sessionlake.scratch import Scratch
from sessionlake.session import Layout
from sessionlake.sources import sinks, transcripts
from sessionlake.sources import text as files

ORDER = ("global_long_term", "project_long_term", "global_short_term", "project_short_term")


def current_project(spark: SparkSession, layout: Layout, cwd: str, settings: dict) -> str | None:
    paths = spark.createDataFrame([(cwd,)], "path string")
    row = index.match_project(paths, transcripts.read_projects_index(spark, layout.projects_index), include_subdirs=settings["projectSettings"]["includeSubdirectories"]).first()
    return row["name"] if row else None


def components(spark: SparkSession, layout: Layout, settings: dict, project: str | None) -> DataFrame:
    """(ord, component, day, text): long-term notes, then short-term days, global before project."""
    lines = files.read_daily(spark, layout.daily)
    rank = lambda name: F.lit(ORDER.index(name)).alias("ord")
    long_term = files.document_size(spark, layout.global_memory, ORDER[0]).select(rank(ORDER[0]), "component", F.lit(None).cast("string").alias("day"), "text")
    out = long_term.unionByName(daily.global_recent(lines, settings["globalShortTerm"]["workingDays"]).select(rank(ORDER[2]), F.lit(ORDER[2]).alias("component"), "day", "text"))
    if project:
        name = spark.range(1).select(x.memory_filename(F.lit(project))).first()[0]
        own = files.document_size(spark, f"{layout.project_memory}/{name}", ORDER[1])
        out = out.unionByName(own.select(rank(ORDER[1]), "component", F.lit(None).cast("string").alias("day"), "text"))
        recent = daily.project_recent(lines, settings["projectShortTerm"]["workingDays"], project)
        out = out.unionByName(recent.select(rank(ORDER[3]), F.lit(ORDER[3]).alias("component"), "day", "text"))
    return out


def context(parts: DataFrame, budget: int, headings: dict[str, str] | None = None) -> DataFrame:
    """(ord, text): the parts in order, ending in a note where the tokens exceed the budget.

    Global days go newest first, project days oldest first. Here bytes are added up before they are divided.
    """
    headings = headings or {c: c.replace("_", " ").title() for c in ORDER}
    days = F.when(F.col("component") == ORDER[2], F.reverse(F.array_sort(F.collect_list(F.struct("day", "text"))))).otherwise(F.array_sort(F.collect_list(F.struct("day", "text"))))
    body = parts.where("text <> ''").groupBy("ord", "component").agg(F.array_join(F.transform(days, lambda d: d["text"]), "\n\n").alias("body"))
    title = F.create_map(*[F.lit(v) for kv in headings.items() for v in kv])[F.col("component")]
    texts = body.select("ord", F.concat(F.lit("## "), title, F.lit("\n\n"), "body").alias("text"))
    tokens = x.usage_tokens(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)))
    note = parts.agg(tokens.alias("t")).where(F.col("t") > budget).select(F.lit(len(ORDER)).alias("ord"), F.concat(F.lit("Memory is over budget: "), F.col("t").cast("string"), F.lit(f" of {budget} tokens")).alias("text"))
    return texts.unionByName(note).orderBy("ord")


def synthesis_due(spark: SparkSession, layout: Layout, now: Column, settings: dict) -> bool:
    stamp = files.read_document(spark, layout.last_synthesis)
    return bool(spark.range(1).select(x.should_synthesize(F.lit(stamp).cast("string"), now, settings["synthesis"]["intervalHours"])).first()[0])


def verified_pending(spark: SparkSession, layout: Layout, exclude: str | None = None) -> DataFrame:
    """Pending sessions with their date that hold an assistant line; only pending transcripts are opened."""
    sessions = transcripts.list_sessions(spark, layout.projects).withColumn("date", x.session_date("created", "file_mtime"))
    todo = pending.pending_sessions(sessions, files.read_ledger(spark, layout.captured), exclude=exclude)
    said = transcripts.assistant_sessions(transcripts.read_lines(spark, layout.projects, transcript_paths(todo)))
    return todo.join(said, ["project_hash", "session_id"], "left_semi")


def transcript_paths(sessions: DataFrame) -> list[str]:
    """File names on the driver, as the reader's own listing holds them."""
    return [r[0] for r in sessions.select("transcript_path").toLocalIterator()]


def day_extract(spark: SparkSession, layout: Layout, day: str | None = None, exclude: str | None = None) -> DataFrame:
    """The extract of pending sessions, of one day or all: lists files first, then opens the pending ones only."""
    sessions = transcripts.list_sessions(spark, layout.projects).withColumn("date", x.session_date("created", "file_mtime"))
    todo = pending.pending_sessions(sessions, files.read_ledger(spark, layout.captured), exclude=exclude)
    if day:
        todo = todo.where(F.col("date") == day)
    todo = Scratch(spark).save(todo, "pending")  # else every use lists the tree again
    return pending.extract(todo, transcripts.messages(transcripts.read_lines(spark, layout.projects, transcript_paths(todo))))


def synthesis_prompt(dates: list[str], projects: list[str], files_by_date: dict[str, tuple[str, int]] | None = None, background: bool = False, model: str | None = None, exclude: str | None = None) -> str:
    """The instructions for the external summariser: what to read, how to tag, where to write, what to mark.

    files_by_date: extracts that are written already, as (path, lines); without them each day
    is still to be extracted, without the session exclude. model: the summariser to ask for.
    """
    days = sorted(dates)
    scopes = ", ".join(["global", *sorted({p for p in projects if p})])
    out = [f"Summarise {len(days)} pending day(s): {', '.join(days)}." + (f" Model: {model}." if model else "") + (" Run in the background." if background else "")]
    if files_by_date:
        out.append("Inputs, each to be read whole and all at once:")
        out += [f"- {d}: read {path} (limit {n + 100} lines)" for d, (path, n) in sorted(files_by_date.items())]
    else:
        out.append("Inputs: extract each day's pending sessions first" + (f", without session {exclude}" if exclude else "") + ".")
    out += [f"- memory/daily/{d}.md, if it is there: its entries stay" for d in days]
    out += ["- memory/global-long-term-memory.md and the notes of the projects concerned, to avoid repeats", ""]
    out.append("Write one note per day, in one go, in this form:")
    out.append("# YYYY-MM-DD")
    for section, kinds in x.TAG_TYPES.items():
        out += [f"## {section}", f"- [scope/{kinds[0]}] text (types: {', '.join(kinds)})"]
    out.append(f"Tag each entry [scope/type]; scopes: {scopes}. Use no other names; global only for what holds across projects.")
    out.append("One entry for each finding; results, not steps on the way.")
    out.append("Route few and lasting entries: [global/*] to the global note, a project's to its own, as - (date) [type] text, unless it is there; mark the daily entry [routed].")
    out.append("Edit each note once, with all its new entries. Correct pinned sections only where a transcript shows that they are out of date.")
    marks = [f"- {path.rsplit('.', 1)[0]}.sessions" for _, (path, _) in sorted((files_by_date or {}).items())]
    out += ["Then mark as captured the sessions listed in:", *marks] if marks else ["Then mark the extracted sessions as captured."]
    out.append("Last, run the decay of notes and write the time to memory/.last-synthesis.")
    return "\n".join(out)


def write_extracts(spark: SparkSession, layout: Layout, days: list[str], folder: str, exclude: str | None = None) -> dict[str, tuple[str, int]]:
    """An extract under the line budget and its session ids for each day that has messages: day to (path, lines)."""
    done = {}
    for day in days:  # one file for each
        path = f"{folder}/extract-{day}.txt"
        if sinks.write_extract(spark, day_extract(spark, layout, day, exclude), path, f"{folder}/extract-{day}.sessions", pending.DAY_LINE_BUDGET):
            done[day] = (path, (files.read_document(spark, path) or "").count("\n") + 1)
    return done


def session_start(spark: SparkSession, layout: Layout, settings: dict, cwd: str, now: datetime, session_id: str | None = None, resumed: bool = False, extracts: str | None = None) -> DataFrame:
    """(ord, text): all that a session starts with: the time, what is pending, the memory, a budget note.

    A resumed session is taken out of the ledger, as it may grow. The running session is never
    pending. If a synthesis is due, the pending days are extracted to the folder extracts (where given)
    and the summariser's prompt is part of the output.
    """
    if resumed and session_id:
        sinks.remove_captured(spark, layout.captured, spark.createDataFrame([(session_id,)], "session_id string"))
    rows = [(0, f"Current time: {now:%Y-%m-%d %H:%M} (UTC{now:%z})")]
    days = [r[0] for r in pending.pending_days(verified_pending(spark, layout, session_id)).collect()]  # dates
    clock = F.lit(now.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    if days and synthesis_due(spark, layout, clock, settings):
        found = write_extracts(spark, layout, days, extracts, session_id) if extracts else {}
        names = [r[0] for r in index.project_names(transcripts.read_projects_index(spark, layout.projects_index)).collect()]
        own = settings["synthesis"]
        prompt = synthesis_prompt(sorted(found) or days, names, found, own["background"], own["model"], session_id)
        rows.append((1, f"## Synthesis is due\nPending days: {len(days)} ({', '.join(days)})\n\n{prompt}"))
    parts = components(spark, layout, settings, current_project(spark, layout, cwd, settings))
    memory = context(parts, settings["totalTokenBudget"]).select((F.col("ord") + 2).alias("ord"), "text")
    return spark.createDataFrame(rows, "ord int, text string").unionByName(memory).orderBy("ord")
