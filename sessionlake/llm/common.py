"""What several corpus operators share: scratch tables, words, row keys."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.scratch import Scratch, clear_scratch, shared_dir

__all__ = ["Scratch", "ascii_lower", "clear_scratch", "row_key", "shared_dir", "ship_code", "slices", "within", "word_chunks", "words_of"]

#: Rows of ids or digests (some tens of MB) up to which a side of a join is broadcast.
MAX_BROADCAST_ROWS = 500_000
#: The characters that separate words in the whitespace-word operators.
WORD_SPACE = "\\x20\\x09-\\x0D"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    Python workers import the operators by name; where the package is not installed on them, the
    driver's file server hands it out.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sessionlake-code-")), "sessionlake-code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone.

    Texts that are all ASCII take the fast path; the rest are translated, as lower()
    would change accented capitals too.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """The whitespace words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The whitespace words of a text, a bounded number of bytes at a time."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end < n:
            found = _SPACE.search(data, end)
            end = found.start() if found else n
        yield data[at:end].split()
        at = end


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in smaller ones, so that what is made from it stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def within(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; a join with more goes by shuffle. df is read twice."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells apart rows that share a doc_id; rows equal in doc_id and text share a key, copies don't."""
    return F.xxhash64(doc_id, doc_id.isNull(), F.coalesce(text, F.lit("")), text.isNull())
