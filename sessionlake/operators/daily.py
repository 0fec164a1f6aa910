"""Daily notes: scope filter, recency, recall, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.functions import text as x
from sessionlake.operators import scan
from sessionlake.sources.text import join_lines


def with_section(lines: DataFrame, key: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """Lines with section (the latest ``## `` heading, stripped; "" before any) and sec_no."""
    head = F.col(line).startswith("## ")
    rows = scan.running(lines, key, order, sums={"sec_no": F.when(head, F.lit(1).cast("bigint"))}, lasts={"section": F.when(head, x.stripped(line))})
    return rows.withColumn("section", F.coalesce("section", F.lit("")))


def scope_lines(lines: DataFrame, scope: str) -> DataFrame:
    """(day, line_no, line) that the scope filter lets through.

    Headings of level one always pass and close the section; a section passes with its
    heading and blank lines if something in it does: an entry tagged with the scope, or, for
    the global scope, a paragraph. Routed and untagged entries and what is in no section don't.
    """
    line = F.col("line")
    top, head = line.startswith("# "), line.startswith("## ")
    rows = scan.running(lines.select("day", "line_no", "line"), "day", "line_no", sums={"part": F.when(top | head, F.lit(1).cast("bigint"))}, lasts={"open": F.when(top, F.lit(False)).when(head, F.lit(True))})
    blank = line.rlike(x.BLANK)
    tag = F.nullif(F.regexp_extract(line, x.TAGGED, 1), F.lit(""))
    paragraph = ~blank & ~x.stripped(line).startswith("-") & F.lit(scope.lower() == "global")
    entry = F.when(tag.isNotNull(), F.lower(tag) == scope.lower()).otherwise(paragraph)
    content = F.coalesce(F.col("open"), F.lit(False)) & ~head & ~line.rlike(x.ROUTED) & entry
    rows = rows.withColumn("content", content).where(top | (F.coalesce(F.col("open"), F.lit(False)) & (head | F.col("content") | (blank & ~line.rlike(x.ROUTED))))).withColumn("__part", F.struct("day", "part"))
    hit = rows.where("content").select("__part").distinct().withColumn("any", F.lit(True))
    return rows.join(hit, "__part", "left").where(top | F.col("any")).select("day", "line_no", "line")


def scope_text(lines: DataFrame, scope: str) -> DataFrame:
    """(day, text): filtered notes put together again; days with nothing but their date are left out."""
    text = F.regexp_replace(join_lines(F.col("line_no"), F.col("line")), r"(?U)(\n\s*)+$", "")
    days = scope_lines(lines, scope).groupBy("day").agg(text.alias("text"))
    return days.where(~F.col("text").rlike(x.BLANK) & ~x.stripped("text").rlike(r"(?U)^#\s+\d{4}-\d{2}-\d{2}\s*$"))


def recent_days(lines: DataFrame, n: int) -> DataFrame:
    return lines.select("day").distinct().orderBy(F.desc("day")).limit(n)


def global_recent(lines: DataFrame, n: int, scope: str = "global") -> DataFrame:
    """The last n days, then filtered: may be fewer. Newest first."""
    return scope_text(lines.join(F.broadcast(recent_days(lines, n)), "day", "left_semi"), scope).orderBy(F.desc("day"))


def project_recent(lines: DataFrame, n: int, project: str | None) -> DataFrame:
    """Filtered, then the last n days with content. Oldest first; no project, no days."""
    found = scope_text(lines, project) if project else scope_text(lines.limit(0), "")
    return found.orderBy(F.desc("day")).limit(n).orderBy("day")


def recall(lines: DataFrame, term: str, around: int = 2, first: str | None = None, last: str | None = None, key: str = "day") -> DataFrame:
    """Lines that hold the term, and those around them, with hit; days within [first, last]."""
    if first:
        lines = lines.where(F.col(key) >= first)
    if last:
        lines = lines.where(F.col(key) <= last)
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    rows = lines.withColumn("hit", F.coalesce(F.lower("line").contains(term.lower()), F.lit(False)))
    return rows.withColumn("near", F.max("hit").over(near)).where("near").drop("near")


def route(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(line, target, routed): where tagged entries go in long-term memory.

    target is ``global`` or the registered project's name; others and routed ones are left out.
    """
    tagged = lines.where(~F.col("line").rlike(x.ROUTED)).withColumn("scope", x.entry_scope("line")).where("scope is not null")
    known = names.select(F.lower("name").alias("scope"), F.col("name").alias("target")).unionByName(names.sparkSession.createDataFrame([("global", "global")], "scope string, target string")).dropDuplicates(["scope"])
    return tagged.join(known, "scope").withColumn("routed", mark(F.col("line"))).drop("scope")


def mark(line: Column) -> Column:
    """An entry with the routed mark before its tag."""
    return F.regexp_replace(line, r"(?U)^(\s*-\s*)", "$1[routed]")


def remember(lines: DataFrame, entry: Column, section: str = "## Pinned", file: str = "file") -> DataFrame:
    """Lines of notes with an entry put at the end of a section, for files that have it.

    The new line gets the section's last line number plus a half, so order needs no rewriting.
    """
    rows = with_section(lines, file)
    ends = rows.where(F.col("section") == section).groupBy(file).agg(F.max(F.when(~F.col("line").rlike(x.BLANK), F.col("line_no"))).alias("at"))
    added = ends.select(file, (F.col("at") + 0.5).alias("line_no"), entry.alias("line"))
    return lines.select(file, F.col("line_no").cast("double").alias("line_no"), "line").unionByName(added)
