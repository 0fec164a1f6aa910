"""Sets of work days as bitmaps of a month, so that they are united and counted without lists of days.

A month's bitmap has bit d - 1 for day d. Bitmaps of one project and month are united by bit_or, in
any order and as often as wanted, so an index of months can be kept incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def day_bit(day: Column) -> Column:
    """A bitmap with the one bit of a date."""
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def months(days: DataFrame, key: str, day: str = "day") -> DataFrame:
    """(key, month, days): a bitmap for each key and month of rows (key, day); null days count for nothing."""
    held = days.where(F.col(day).isNotNull())
    return held.groupBy(key, month_of(F.col(day)).alias("month")).agg(F.bit_or(day_bit(F.col(day))).alias("days"))


def unite(*sides: DataFrame, key: str) -> DataFrame:
    """Month bitmaps of several tables as one."""
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(key, "month").agg(F.bit_or("days").alias("days"))


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Bits of left that right lacks; months without any are left out."""
    other = right.select(F.col(key).alias("__k"), F.col("month").alias("__m"), F.col("days").alias("__d"))
    rows = left.join(other, F.col(key).eqNullSafe(F.col("__k")) & (F.col("month") == F.col("__m")), "left")
    return rows.select(key, "month", F.col("days").bitwiseAND(F.bitwise_not(F.coalesce("__d", F.lit(0)))).alias("days")).where("days <> 0")


def day_list(month: Column, days: Column) -> Column:
    """The days of a bitmap in order, as text."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(31)), lambda d: F.call_function("getbit", days, d - 1) == 1), lambda d: F.concat(month, F.lit("-"), F.lpad(d.cast("string"), 2, "0")))


def days_after(entries: DataFrame, bitmaps: DataFrame, key: str, entry_day: str) -> DataFrame:
    """entries with days_after: the key's work days later than the entry's; null for keys without any.

    A key's months, a dozen a year, are one row; of the entry's own month the bits above its day
    count, of later months all. Entries are joined once and never meet single days.
    """
    listed = bitmaps.groupBy(F.col(key).alias("__k")).agg(F.collect_list(F.struct("month", "days")).alias("__months"))
    rows = entries.join(listed, F.col(key).eqNullSafe(F.col("__k")), "left")
    month, day = month_of(F.col(entry_day)), F.dayofmonth(entry_day)
    left = lambda z: F.when(z["month"] > month, F.bit_count(z["days"])).when(z["month"] == month, F.bit_count(F.call_function("shiftright", z["days"], day))).otherwise(F.lit(0))
    total = F.aggregate("__months", F.lit(0).cast("bigint"), lambda a, z: a + left(z))
    return rows.withColumn("days_after", F.when(F.col("__months").isNotNull(), total)).drop("__k", "__months")
