"""Small frames with the awkward cases: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, rows: list[tuple], partitions: int = 3):
    """documents-like frame of (doc_id, text) with columns that clash with the operators' own."""
    full = [(d, t, "x", 1, "y", True, 2, 3.0) for d, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, key string, n bigint, packed string, kept boolean, start bigint, h double").repartition(partitions)


def empty(spark):
    return docs(spark, [], 1)
