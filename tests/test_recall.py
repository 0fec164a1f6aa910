"""The index finds the lines that a scan finds, and reads few files for a rare term."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import daily, recall


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    lines = [("hot", i, f"Line {i} of the day, see note-{i % 50}") for i in range(3000)] + [("b", 0, "Über-Größe"), ("b", 1, None), ("b", 2, ""), ("b", 3, "foo_bar.baz qux"), ("b", 4, "日本語 text"), (None, 0, "null key Zebra"), (None, 1, "after")]
    df = spark.createDataFrame([(d, i, t, "x") for d, i, t in lines], "day string, line_no int, line string, token string").repartition(3)
    folder = str(tmp_path_factory.mktemp("recall"))
    recall.build(df, folder)
    return df, folder


@pytest.mark.parametrize("term", ["note-17", "ote-4", "Zebra", "BAR.ba", "größe", "日本", "line 299", "the", "nothing such", "x qu", "...", "_", ""])
@pytest.mark.parametrize("around", [0, 2])
def test_same_as_a_scan(spark, notes, term, around):
    df, folder = notes
    want = daily.recall(df.select("day", "line_no", "line"), term, around).select("day", F.col("line_no").cast("bigint"), "line", "hit").collect()
    got = recall.search(spark, folder, term, around).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_a_rare_term_reads_few_buckets(spark, notes):
    _, folder = notes
    plan = recall.search(spark, folder, "zebra")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+\)", plan)) >= 2 or len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) >= 2
    picked = recall._picked(spark.read.parquet(f"{folder}/postings"), spark.createDataFrame([("zebra",)], "token string"), "token")
    assert picked.count() == 1 and picked.select(F.input_file_name()).distinct().count() == 1


def test_many_tokens_go_by_join(spark, notes, monkeypatch):
    df, folder = notes
    monkeypatch.setattr(recall, "MOST", 3)
    want = daily.recall(df.select("day", "line_no", "line"), "e").count()
    assert recall.search(spark, folder, "e").count() == want > 2000


def test_empty(spark, tmp_path):
    recall.build(spark.createDataFrame([], "day string, line_no int, line string"), str(tmp_path))
    assert recall.search(spark, str(tmp_path), "x").collect() == []
