"""Running values by chunks against the plain window, with one key that holds everything, nulls, repeats and none."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlake.operators import decay, scan, workdays


def by_window(df):
    so_far = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("s", F.coalesce(F.sum("v").over(so_far), F.lit(0))).withColumn("last", F.last("t", ignorenulls=True).over(so_far)).withColumn("all", F.coalesce(F.sum("v").over(Window.partitionBy("k")), F.lit(0)))


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_running(spark, width):
    rows = [("hot", i, (i * 37) % 11 if i % 4 else None, f"t{i}" if i % 10 == 3 else None) for i in range(500)]
    rows += [(None, i, 1, None) for i in range(20)] + [("neg", -i, i, "x" if i == 9 else None) for i in range(30)] + [("gap", 10**9 * i, i, f"g{i}") for i in range(9)] + [("one", None, 5, "n")]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, t string").repartition(5)
    got = scan.running(df, "k", "o", {"s": F.col("v")}, {"last": F.col("t")}, {"all": F.col("v")}, width)
    assert got.columns == ["k", "o", "v", "t", "s", "last", "all"]
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, by_window(df).collect()), key=key)


def test_no_task_holds_a_whole_key(spark):
    """With one key the window is cut by chunks, and no plan node groups rows by the key alone."""
    df = spark.range(100_000).select(F.lit("one").alias("k"), F.col("id").alias("o"), F.lit(1).cast("bigint").alias("v"))
    got = scan.running(df, "k", "o", {"s": F.col("v")}, width=1000)
    assert got.where("s <> o + 1").isEmpty()
    parts = got.select(F.floor(F.col("o") / 1000).alias("c"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.countDistinct("c").alias("n"))
    assert parts.agg(F.max("n")).first()[0] < 100


def test_several_keys_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 1, 3), ("a", 1, 2, 4)], "k string, j int, o bigint, v bigint")
    got = {(r["k"], r["j"], r["o"]): r["s"] for r in scan.running(df, ["k", "j"], "o", {"s": F.col("v")}).collect()}
    assert got == {("a", 1, 1): 2, ("a", 1, 2): 6, ("a", 2, 1): 3}
    assert scan.running(df.limit(0), "k", "o", {"s": F.col("v")}).collect() == []


def test_work_day_bitmaps(spark):
    days = [("p", date(2024, 1, d)) for d in (1, 31, 31, 5)] + [("p", date(2024, 2, 29)), ("q", date(2023, 12, 31)), (None, date(2024, 1, 2)), ("q", None)]
    table = spark.createDataFrame(days, "k string, day date")
    made = workdays.months(table, "k")
    listed = {(r["k"], r["month"]): list(r["l"]) for r in made.withColumn("l", workdays.day_list(F.col("month"), F.col("days"))).collect()}
    assert listed == {("p", "2024-01"): ["2024-01-01", "2024-01-05", "2024-01-31"], ("p", "2024-02"): ["2024-02-29"], ("q", "2023-12"): ["2023-12-31"], (None, "2024-01"): ["2024-01-02"]}
    twice = workdays.unite(made, made, workdays.months(table.where("k = 'q'"), "k"), key="k")
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in made.collect()}
    less = workdays.only_in(made, workdays.months(table.where("day <= '2024-01-05'"), "k"), "k")
    assert {(r["k"], r["month"]): r["days"] for r in less.collect()} == {("p", "2024-01"): 1 << 30, ("p", "2024-02"): 1 << 28}


def test_days_after_equals_the_window_form(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    entries = events.select("user_id", F.date_add(F.to_date("ts"), (F.col("event_id") % 40 - 20).cast("int")).alias("entry")).union(spark.sql("select -1L, date '2024-01-01'")).distinct()
    plain = decay.work_days_after(entries, days, "user_id", "entry", "day")
    made = workdays.days_after(entries, workdays.months(days, "user_id"), "user_id", "entry")
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in plain.collect()}
