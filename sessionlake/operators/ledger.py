"""The captured ledger: a set of session ids, changed by anti- and semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def add(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger with ids; adding twice changes nothing."""
    return ledger.select("session_id").unionByName(ids.select("session_id")).distinct()


def remove(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return ledger.join(ids, "session_id", "left_anti")


def removed(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger's ids that remove() drops; their number is the reported count."""
    return ledger.join(ids, "session_id", "left_semi")


def final_ids(sidecar: DataFrame, sessions: DataFrame, today: Column) -> DataFrame:
    """Sidecar ids that may be marked: all but those whose session is of today.

    sessions: (session_id, date). Ids that no session has are marked as well.
    """
    dated = sessions.groupBy("session_id").agg(F.max("date").alias("date"))
    return sidecar.join(dated, "session_id", "left").where(F.col("date").isNull() | (F.col("date") != today)).select("session_id").distinct()


def of_dates(ledger: DataFrame, sessions: DataFrame, dates: list[str]) -> DataFrame:
    """The ledger's ids whose session is of one of the dates."""
    return ledger.join(sessions.where(F.col("date").isin(dates)), "session_id", "left_semi")
