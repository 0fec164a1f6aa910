"""The ledger as a table: a change rewrites the partitions of its days only."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from sessionlake.sources import ledger_table
from sessionlake.sources.sinks import dynamic_overwrite


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, day string")


def files(path):
    return {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in Path(path).glob("day=*")}


def held(spark, path, days=None):
    return sorted(map(tuple, ledger_table.held(spark, path, days).collect()))


def test_changes(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    assert held(spark, path) == [] and ledger_table.remove(spark, path, ids(spark, ("a", "d1"))) == []
    assert sorted(ledger_table.add(spark, path, ids(spark, ("a", "d1"), ("b", "d1"), ("c", "d2"), ("c", "d2"), ("n", None), ("", "d9"), (None, "d9")))) == ["d1", "d2", "none"]
    want = [("a", "d1"), ("b", "d1"), ("c", "d2"), ("n", "none")]
    assert held(spark, path) == want
    was = files(path)
    assert ledger_table.add(spark, path, ids(spark, ("a", "d1"))) == [] and files(path) == was
    assert ledger_table.add(spark, path, ids(spark, ("e", "d2"), ("a", "d1"))) == ["d2"]
    now = files(path)
    assert now["day=d1"] == was["day=d1"] and now["day=none"] == was["day=none"] and now["day=d2"] != was["day=d2"]
    assert held(spark, path, ["d2"]) == [("c", "d2"), ("e", "d2")]
    assert ledger_table.remove(spark, path, ids(spark, ("c", "d1"), ("z", "d2"))) == [] and files(path) == now
    assert ledger_table.remove(spark, path, ids(spark, ("c", "d2"), ("e", "d2"))) == ["d2"]
    assert held(spark, path) == [("a", "d1"), ("b", "d1"), ("n", "none")]
    assert ledger_table.remove(spark, path, ids(spark, ("b", "x")).select("session_id")) == ["d1"]
    assert held(spark, path) == [("a", "d1"), ("n", "none")]
    assert ledger_table.add(spark, path, ids(spark, ("c", "d2"))) == ["d2"] and ("c", "d2") in held(spark, path)


def test_only_partitions_of_the_days_are_read(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger_table.add(spark, path, ids(spark, *[(f"s{k}", f"d{k % 7}") for k in range(70)]))
    some = ledger_table.held(spark, path, ["d3", "d5"])
    assert some.count() == 20 and re.search(r"PartitionFilters: \[[^\]]*day#\d+ IN \(d3,d5\)", some._jdf.queryExecution().executedPlan().toString())


def test_one_day_has_all_and_text_import(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    many = spark.range(20_000).selectExpr("cast(id as string) as session_id")
    sessions = many.selectExpr("session_id", "'2024-01-01' as date").where("session_id <> '7'")
    assert sorted(ledger_table.import_text(spark, path, many, sessions)) == ["2024-01-01", "none"]
    assert ledger_table.held(spark, path).count() == 20_000 and held(spark, path, ["none"]) == [("7", "none")]
    assert ledger_table.remove(spark, path, many.where("session_id <> '9'")) and held(spark, path) == [("9", "2024-01-01")]


def test_the_session_keeps_its_setting(spark, tmp_path):
    was = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    ledger_table.add(spark, f"{tmp_path}/l", ids(spark, ("a", "d")))
    with pytest.raises(RuntimeError), dynamic_overwrite(spark):
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"
        raise RuntimeError
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == was
