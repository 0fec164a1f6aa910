"""Decay of long-term entries: by calendar or working days, archive, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.functions import text as x
from sessionlake.operators.daily import with_section

# Default ages in days.
AGE_DAYS, PROJECT_WORK_DAYS, RETENTION_DAYS = 30, 20, 365


def work_days_after(entries: DataFrame, days: DataFrame, key: str, entry_day: str, work_day: str) -> DataFrame:
    """entries with days_after: how many of the key's work days come after the entry's.

    One pass over both, by window: no range join, and entry days need not be work days.
    Repeated work days count as often as they come; keys without any have null.
    """
    both = entries.select(key, F.col(entry_day).cast("date").alias("__day"), F.lit(0).alias("__w")).distinct().unionByName(days.select(key, F.col(work_day).cast("date").alias("__day"), F.lit(1).alias("__w")))
    after = Window.partitionBy(key).orderBy(F.desc("__day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(key, "__day")
    counts = both.withColumn("__n", F.sum("__w").over(after) - F.sum("__w").over(same)).withColumn("__all", F.sum("__w").over(Window.partitionBy(key))).where("__w = 0")
    counts = counts.select(key, F.col("__day").alias("__d"), F.when(F.col("__all") > 0, F.col("__n")).cast("bigint").alias("days_after"))
    rows = entries.withColumn("__d", F.col(entry_day).cast("date"))
    return rows.join(counts, [key, "__d"], "left").drop("__d")


def classify(lines: DataFrame, as_of: Column, age_days: int = AGE_DAYS, work_days: DataFrame | None = None, threshold: int = PROJECT_WORK_DAYS, compat: bool = False) -> DataFrame:
    """Lines of notes (file, line_no, line) with section, sec_no, entry_date and action: keep, archive or drop.

    work_days: (file, day); files that have some decay by working days, others by calendar.
    Only dated list items of eligible sections are archived. With compat, a file that loses an entry is
    rebuilt: eligible sections keep their list items, or, where none stay, their comments.
    """
    rows = with_section(lines, "file").withColumn("eligible", x.is_decay_eligible("section") & ~F.col("line").startswith("## "))
    rows = rows.withColumn("item", F.col("eligible") & x.stripped("line").startswith("- ")).withColumn("entry_date", F.when(F.col("item"), x.entry_date("line")))
    if work_days is not None:
        dated = work_days_after(rows.where("entry_date is not null").select("file", "entry_date").distinct(), work_days, "file", "entry_date", "day")
        rows = rows.join(dated, ["file", "entry_date"], "left")
        old = x.should_decay("entry_date", as_of, age_days, F.col("days_after"), threshold)
    else:
        old = x.should_decay("entry_date", as_of, age_days)
    rows = rows.withColumn("gone", F.coalesce(F.col("item") & old, F.lit(False)))
    action = F.when(F.col("gone"), F.lit("archive")).otherwise(F.lit("keep"))
    if compat:
        whole, part = Window.partitionBy("file"), Window.partitionBy("file", "sec_no")
        rows = rows.withColumn("touched", F.max("gone").over(whole)).withColumn("left", F.max(F.col("item") & ~F.col("gone")).over(part))
        lost = F.col("touched") & F.col("eligible") & ~F.col("item") & (F.col("left") | ~x.stripped("line").startswith("<!--"))
        action = F.when(F.col("gone"), F.lit("archive")).when(lost, F.lit("drop")).otherwise(F.lit("keep"))
    return rows.select("file", "line_no", "line", "section", "sec_no", "entry_date", action.alias("action"))


def render(classified: DataFrame) -> DataFrame:
    """(file, text) of what is kept, section by section, ending in one newline."""
    body = F.filter(F.array_sort(F.collect_list(F.struct("line_no", F.when((F.col("action") == "keep") & ~F.col("line").startswith("## "), F.col("line")).alias("l")))), lambda z: z["l"].isNotNull())
    parts = classified.groupBy("file", "sec_no", "section").agg(F.array_join(F.transform(body, lambda z: z["l"]), "\n").alias("b"))
    text = F.concat(F.when(F.col("section") != "", F.concat("section", F.lit("\n"))).otherwise(F.lit("")), "b", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("sec_no", text.alias("t"))))
    joined = parts.groupBy("file").agg(F.array_join(F.transform(ordered, lambda z: z["t"]), "").alias("t"))
    return joined.select("file", F.concat(x.stripped("t"), F.lit("\n")).alias("text"))


def archived(classified: DataFrame, as_of: Column) -> DataFrame:
    """(archived_on, entry, source_file, seq) of the archived entries."""
    gone = classified.where("action = 'archive'")
    return gone.select(as_of.alias("archived_on"), F.concat(x.stripped("line"), F.lit("\n  - *Source: "), "file", F.lit("*")).alias("entry"), F.col("file").alias("source_file"), F.col("line_no").cast("int").alias("seq"))


def append_archive(archive: DataFrame, new: DataFrame) -> DataFrame:
    return archive.unionByName(new)


def render_archive(archive: DataFrame) -> DataFrame:
    """(archived_on, text) of the archive's sections, newest first."""
    ordered = F.array_sort(F.collect_list(F.struct("source_file", "seq", "entry")))
    text = F.concat(F.lit("## Archived "), F.col("archived_on").cast("string"), F.lit("\n"), F.array_join(F.transform("es", lambda e: F.concat(e["entry"], F.lit("\n\n"))), ""))
    return archive.groupBy("archived_on").agg(ordered.alias("es")).select("archived_on", text.alias("text")).orderBy(F.desc("archived_on"))


def parse_archive(lines: DataFrame) -> DataFrame:
    """(archived_on, line_no, line): the archive file's lines; those of no valid section have null."""
    rows = lines.withColumn("head", F.try_to_date(F.nullif(F.regexp_extract(x.stripped("line"), r"^## Archived (\d{4}-\d{2}-\d{2})$", 1), F.lit("")), "yyyy-MM-dd"))
    return rows.select(F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)).alias("archived_on"), "line_no", "line")


def purge(archive: DataFrame, as_of: Column, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """What stays of the archive: sections not older than retention_days, and undated rows."""
    return archive.where(F.col("archived_on").isNull() | (F.col("archived_on") >= F.date_sub(as_of, retention_days)))


def purged_sections(archive: DataFrame, as_of: Column, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """The dates of the sections that purge() drops; their number is the reported count."""
    return archive.where(F.col("archived_on") < F.date_sub(as_of, retention_days)).select("archived_on").distinct()
