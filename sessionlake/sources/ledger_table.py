"""The captured ledger as a table: ids partitioned by the day of their session, changed a partition at a time.

A change reads and rewrites the partitions of the days that it touches and no other, by dynamic partition
overwrite, so its cost follows the change and not the ledger; no id passes through the driver.
Ids of no known day are in a partition of their own. The text form is for import and export. A day
that loses all its ids keeps a file without rows. Changes are made by one writer at a time, as with
the text form under sinks.locked().
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.sources.sinks import replace_partitions

SCHEMA = "session_id string, day string"
#: The partition of ids without a day.
NO_DAY = "none"


def read(spark: SparkSession, table: str, days: list[str] | None = None) -> DataFrame:
    """(session_id, day); of some days only their partitions are read. A table that isn't there is empty."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(table)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    return rows if days is None else rows.where(F.col("day").isin(days))


def _dated(ids: DataFrame) -> DataFrame:
    day = F.coalesce(F.nullif(F.col("day"), F.lit("")), F.lit(NO_DAY))
    return ids.where("session_id <> ''").select("session_id", day.alias("day")).distinct()


def _days(ids: DataFrame) -> list[str]:
    return [r["day"] for r in ids.select("day").distinct().collect()]  # days, not ids


def _put(spark: SparkSession, table: str, rows: DataFrame, days: list[str]) -> None:
    """Rows in place of the partitions of the days; a day that has none left gets a null id, which reads leave out."""
    blank = spark.createDataFrame([(None, d) for d in days], SCHEMA)
    replace_partitions(rows.unionByName(blank), table, ["day"])


def held(spark: SparkSession, table: str, days: list[str] | None = None) -> DataFrame:
    """The ids in the ledger with their days."""
    return read(spark, table, days).where("session_id is not null")


def add(spark: SparkSession, table: str, ids: DataFrame) -> list[str]:
    """Adds ids (session_id, day), each once a day; the days whose partitions were rewritten: those that gained an id."""
    fresh = _dated(ids)
    fresh = fresh.join(held(spark, table, _days(fresh)), ["session_id", "day"], "left_anti")
    days = _days(fresh)
    if days:
        _put(spark, table, held(spark, table, days).unionByName(fresh), days)
    return days


def remove(spark: SparkSession, table: str, ids: DataFrame) -> list[str]:
    """Takes ids (session_id, and day if that is known) out; the days whose partitions were rewritten: those that lost one.

    Without days the ids are looked up in the whole table first, but only the partitions that have any are rewritten.
    """
    gone = _dated(ids) if "day" in ids.columns else held(spark, table).join(ids.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "day")
    within = held(spark, table, _days(_dated(ids))) if "day" in ids.columns else held(spark, table)
    days = _days(within.join(gone, ["session_id", "day"], "left_semi"))
    if days:
        _put(spark, table, held(spark, table, days).join(gone, ["session_id", "day"], "left_anti"), days)
    return days


def import_text(spark: SparkSession, table: str, ledger: DataFrame, sessions: DataFrame) -> list[str]:
    """Adds the ids of a text ledger (session_id), dated by the sessions (session_id, date) that are known."""
    dated = sessions.groupBy("session_id").agg(F.max("date").alias("day"))
    return add(spark, table, ledger.select("session_id").join(dated, "session_id", "left"))
