"""Scalar rules, case by case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import settings, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ('"plain"', "plain"), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]', "a\nb"), ("null", ""), ("17", ""), ("[]", ""), ('"[1]"', "[1]"),
        ('[{"type":"text"}]', ""), ('[1,{"type":"text","text":"a"}]', "a"), ('{"type":"text"}', ""),
    ],
)
def test_flatten(spark, content, want):
    assert one(spark, text.flatten_content(F.try_parse_json("v")), v=content) == want


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("Base directory for this skill: /x", True), ("x" * 186 + "<command-name>", True), ("x" * 190 + "<command-name>", False), ("a <system-reminder> b", True),
        (" [Request interrupted by user]\n", True), ("[Request interrupted by user] go on", False), ("hello", False), ("", False),
    ],
)
def test_noise(spark, message, want):
    assert one(spark, text.is_noise("m"), m=message) is want


@pytest.mark.parametrize(
    ("line", "want"), [("- (2026-01-05) [x] y", "2026-01-05"), ("no date", None), ("- (2026-02-30) a (2026-01-01)", None), ("- (2026-1-3)", None), ("a (2025-12-31) b", "2025-12-31")]
)
def test_entry_date(spark, line, want):
    got = one(spark, text.entry_date("l"), l=line)
    assert (got and got.isoformat()) == want


def test_keywords(spark):
    got = one(spark, text.keywords("l"), l="- [routed][proj/gotcha] The Parquet reader is slow when reading the parquet_files by id")
    assert sorted(got) == ["parquet", "parquet_files", "reader", "reading", "slow"]
    assert one(spark, text.keywords("l"), l="- (2026-02-12) [pattern] of the") == []


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("- [g/pattern] Use worktrees for parallel branch development", "- (2026-02-12) [pattern] Parallel branch development works with worktrees", True),
        ("- [g/pattern] Use worktrees for parallel development", "- (2026-02-12) [gotcha] Dates must carry offsets", False),
        ("- [g/pattern] of the", "- (2026-02-12) [pattern] of the", False),
    ],
)
def test_match(spark, a, b, want):
    assert one(spark, text.is_routed_match("a", "b"), a=a, b=b) is want


@pytest.mark.parametrize(("name", "want"), [("My Project", "my-project"), ("a__b  c", "ab-c"), ("--Über.Größe 1--", "übergröße-1")])
def test_kebab(spark, name, want):
    assert one(spark, text.memory_filename("n"), n=name) == f"{want}-long-term-memory.md"


def test_paths(spark):
    assert one(spark, text.encode_path("p"), p="/home/u/a.b") == "-home-u-a-b"
    assert one(spark, text.decode_path("p"), p="-home-u") == "/home/u"
    assert one(spark, text.basename("p"), p="/home/u/x/") == "x"
    assert one(spark, text.count_literal("p", "aa"), p="aaaaa") == 2


@pytest.mark.parametrize(
    ("created", "want"), [("2026-02-01T23:30:00-05:00", "2026-02-01"), ("2026-02-01T10:00:00Z", "2026-02-01"), ("bad", "2026-03-04"), (None, "2026-03-04")]
)
def test_session_date(spark, created, want):
    assert one(spark, text.session_date(F.col("c"), F.lit("2026-03-04 05:06:07").cast("timestamp")), c=created) == want


@pytest.mark.parametrize(
    ("stamp", "hours", "want"), [(None, 2, True), ("bad", 2, True), ("2026-02-11T23:59:00+00:00", 24, True), ("2026-02-12T11:30:00+00:00", 2, False), ("2026-02-12T09:00:00", 2, True), ("2026-02-12T10:00:00Z", 2, False)]
)
def test_schedule(spark, stamp, hours, want):
    now = F.lit("2026-02-12 12:00:00").cast("timestamp")
    assert one(spark, text.should_synthesize("s", now, hours), s=stamp) is want


@pytest.mark.parametrize(
    ("event", "want"),
    [
        ('{"tool_name":"Read","p":"/h/.assistant/memory/x"}', True), ('{"tool_name":"Skill","skill":"recall"}', True), ('{"tool_name":"Skill","skill":"projects"}', False),
        ('{"tool_name":"Task","prompt":"Synthesize it"}', True), ('{"tool_name":"Bash","c":"ls /tmp/x"}', True), ('{"tool_name":"Bash","c":"ls"}', False), ('{"tool_name":"Bash","c":"/h/.assistant/scripts/a"}', True),
    ],
)
def test_allowed(spark, event, want):
    assert one(spark, text.is_allowed("e"), e=event) is want


def test_sql_functions(spark):
    text.register_sql(spark)
    row = spark.sql("select estimate_tokens('abcdefghi'), entry_keywords('- [a/b] Slow Reader of it'), overlap_coefficient(array('a', 'b'), array('b')), overlap_coefficient(array(), array('b'))").first()
    assert (row[0], sorted(row[1]), row[2], row[3]) == (2, ["reader", "slow"], 1.0, None)


def test_settings():
    base = settings.parse_settings(None)
    assert base["totalTokenBudget"] == 16750
    assert settings.parse_settings("{bad") == base
    user = settings.parse_settings(json.dumps({"globalShortTerm": {"workingDays": 4}}))
    assert user["globalShortTerm"]["tokenLimit"] == 3000
    assert "tokenLimit" not in settings.DEFAULTS["globalShortTerm"]
    assert settings.set_value(base, "decay.ageDays", 60)["decay"]["ageDays"] == 60
    assert settings.reset(user, "globalShortTerm.workingDays") == base
    for path, value in (("decay.ageDays", 6), ("synthesis.background", 1), ("nothing.here", 1), ("globalShortTerm.workingDays", True)):
        with pytest.raises(ValueError):
            settings.set_value(base, path, value)
    assert settings.usage_ratio(50, 100) == (50.0, False)
