"""Sessions still to be processed, their extracts and the line budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators import scan

MIN_SIZE, MIN_LINES = 1000, 15
DAY_LINE_BUDGET = 1950


def pending_sessions(sessions: DataFrame, captured: DataFrame, min_size: int = MIN_SIZE, exclude: str | None = None, assistant: DataFrame | None = None) -> DataFrame:
    """Sessions not in the ledger, of min_size bytes or more, other than exclude.

    assistant: (project_hash, session_id) with an assistant line; given, others are dropped.
    The size filter prunes whole files before any join.
    """
    some = sessions.where(F.col("file_size") >= min_size)
    if exclude is not None:
        some = some.where(~F.col("session_id").eqNullSafe(F.lit(exclude)))
    some = some.join(captured.select("session_id"), "session_id", "left_anti")
    return some if assistant is None else some.join(assistant, ["project_hash", "session_id"], "left_semi")


def pending_days(pending: DataFrame) -> DataFrame:
    return pending.select("date").distinct().orderBy("date")


def extract(pending: DataFrame, messages: DataFrame) -> DataFrame:
    """One row for each pending session with messages: date, ids, message_count, messages in order."""
    key = ["project_hash", "session_id"]
    one = F.array_sort(F.collect_list(F.struct("line_no", "role", "content")))
    talk = messages.groupBy(*key).agg(F.count("*").alias("message_count"), one.alias("messages"))
    return pending.join(talk, key)


def day_totals(extracted: DataFrame) -> DataFrame:
    """(date, sessions, messages) of an extract."""
    return extracted.groupBy("date").agg(F.count("*").alias("sessions"), F.sum("message_count").cast("bigint").alias("messages"))


def budget_lines(lines: DataFrame, session: str, order: str, total: int) -> DataFrame:
    """Lines kept under a total budget, with cut: the number of lines left out before this one.

    Each session may have total // sessions lines, MIN_LINES at least; of a longer one
    the first third and the last two thirds of that stay.
    """
    sessions = lines.select(session).distinct().agg(F.greatest(F.floor(F.lit(total) / F.greatest(F.count("*"), F.lit(1))), F.lit(MIN_LINES)).cast("int").alias("__cap"))
    one = F.lit(1).cast("bigint")
    rows = scan.running(lines, session, order, sums={"__rn": one}, totals={"__n": one}).join(F.broadcast(sessions))
    n, rn, cap = F.col("__n"), F.col("__rn"), F.col("__cap")
    head = F.floor(cap / 3)
    tail_from = n - (cap - head)
    kept = rows.where((n <= cap) | (rn <= head) | (rn > tail_from))
    cut = F.when((n > cap) & (rn == tail_from + 1), n - cap).otherwise(F.lit(0)).cast("bigint")
    return kept.withColumn("cut", cut).drop("__cap", "__n", "__rn")


def format_extract(extracted: DataFrame, total: int | None = None, assistant_label: str = "ASSISTANT") -> DataFrame:
    """(date, ord, text): the readable extract, to be joined by newlines in order of date and ord.

    Days ascend, sessions go newest first; headings don't count against the budget.
    """
    label = lambda m: F.concat(F.lit("\n["), F.when(m["role"] == "user", F.lit("USER")).otherwise(F.lit(assistant_label)), F.lit("]\n"), m["content"])
    body = extracted.select("date", "project_hash", "session_id", "file_mtime", F.array_join(F.transform("messages", label), "\n").alias("body"))
    lines = body.select("date", "file_mtime", F.struct("project_hash", "session_id").alias("s"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    if total:
        lines = budget_lines(lines, "s", "line_no", total)
        lines = lines.withColumn("line", F.when(F.col("cut") > 0, F.concat(F.lit("\n... ["), F.col("cut").cast("string"), F.lit(" lines truncated] ...\n"), F.col("line"))).otherwise(F.col("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda z: z["line"]), "\n")
    bar, rule = "─" * 70, "=" * 70
    head = F.concat(F.lit(f"\n{bar}\nSession: "), F.col("s.session_id"), F.lit(f"\n{bar}\n"))
    rows = lines.groupBy("date", "s", "file_mtime").agg(text.alias("t")).select("date", (F.row_number().over(Window.partitionBy("date").orderBy(F.desc("file_mtime"), "s"))).alias("ord"), F.concat(head, "t").alias("text"))
    title = F.concat(F.lit(f"\n{rule}\nDAY: "), F.col("date"), F.lit(" ("), F.col("sessions").cast("string"), F.lit(" sessions, "), F.col("messages").cast("string"), F.lit(f" messages)\n{rule}"))
    return day_totals(extracted).select("date", F.lit(0).alias("ord"), title.alias("text")).unionByName(rows).orderBy("date", "ord")


def captured_flags(sessions: DataFrame, captured: DataFrame) -> DataFrame:
    """Sessions with captured: whether the ledger has them."""
    held = captured.select("session_id").distinct().withColumn("captured", F.lit(True))
    return sessions.join(held, "session_id", "left").fillna(False, ["captured"])
