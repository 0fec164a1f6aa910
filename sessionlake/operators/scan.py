"""Running values over rows in order of a key, where one key may hold any number of rows.

A plain window puts all rows of a key into one task. Here a key's rows are cut into chunks of the
order column, WIDTH values wide; each chunk is scanned by itself, a chunk's totals make one carry
record, the carries of a key are scanned in turn, and every row adds the carry of the chunks
before its own. A task holds one chunk, so at most WIDTH rows if the order is unique in its key,
and a key's carries are WIDTH times fewer than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Values of the order column in a chunk.
WIDTH = 1 << 16


def running(
    rows: DataFrame, key: str | list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, totals: dict[str, Column] | None = None, width: int = WIDTH
) -> DataFrame:
    """rows with, in order within each key: running sums, the last non-null values so far, and whole sums of the key.

    order: a whole-number column. Both running kinds take the row itself in. Sums of nulls alone are
    0; before the first non-null value the last is null. Null keys are a key of their own; rows with
    a null order come before all others. Rows that tie in order are in one chunk and in no
    stated order. An empty table gives no rows.
    """
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    keys = [key] if isinstance(key, str) else key
    names = rows.columns
    cells = rows.select("*", F.struct(*keys).alias("__key"), F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))).cast("bigint").alias("__chunk"), *[c.alias(f"__in_{n}") for n, c in (sums | lasts | totals).items()])
    place = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 62)))
    with_value = lambda n: F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), place))
    parts = cells.groupBy("__key", "__chunk").agg(
        F.count("*").alias("__rows"), *[F.coalesce(F.sum(f"__in_{n}"), F.lit(0)).alias(f"__of_{n}") for n in sums | totals], *[with_value(n).alias(f"__of_{n}") for n in lasts]
    )
    of_key = Window.partitionBy("__key")
    before = of_key.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = parts.select(
        "__key", "__chunk", *[F.coalesce(F.sum(f"__of_{n}").over(before), F.lit(0)).alias(f"__was_{n}") for n in sums],
        *[F.last(f"__of_{n}", ignorenulls=True).over(before).alias(f"__was_{n}") for n in lasts], *[F.sum(f"__of_{n}").over(of_key).alias(f"__was_{n}") for n in totals],
    )
    so_far = Window.partitionBy("__key", "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = cells.select("*", *[F.coalesce(F.sum(f"__in_{n}").over(so_far), F.lit(0)).alias(f"__now_{n}") for n in sums], *[F.last(f"__in_{n}", ignorenulls=True).over(so_far).alias(f"__now_{n}") for n in lasts])
    joined = scanned.join(carries, ["__key", "__chunk"])
    return joined.select(
        *names, *[(F.col(f"__now_{n}") + F.col(f"__was_{n}")).alias(n) for n in sums], *[F.coalesce(f"__now_{n}", f"__was_{n}").alias(n) for n in lasts], *[F.col(f"__was_{n}").alias(n) for n in totals]
    )
