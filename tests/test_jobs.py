"""The jobs: over growing input, after a failure half-way, with awkward rows, again with nothing new, and against their SQL."""

from __future__ import annotations

import json
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from oracle import connect, same

from jobs import context_plan, queries, work_day_index

ROOT = Path(__file__).resolve().parents[1]
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, name, sf):
    path = f"/root/testdata/sf{sf}"
    same(queries.QUERIES[name](spark, path), connect(path), queries.ORACLE_SQL[name])


def drop(spark, folder, rows):
    spark.createDataFrame([(i, datetime.fromisoformat(ts) if ts else None, u, t, 1.0, "{}") for i, ts, u, t in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def index(spark, out):
    return {(r["project"], r["month"]): (r["n_days"], r["work_days"], r["events"], r["folders"]) for r in work_day_index.read_index(spark, out).collect()}


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_work_days_of_growing_events(spark, tmp_path):
    events, out = f"{tmp_path}/events", f"{tmp_path}/out"
    was = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    drop(spark, events, [(1, "2024-01-05 10:00:00", 7, "a"), (2, "2024-01-31 23:59:59", 7, "b"), (3, "2024-02-01 00:00:00", 7, None), (4, None, 7, "a"), (5, "2024-01-05 10:00:00", None, "a"), (1, "2024-01-05 10:00:00", 7, "a")])
    first = work_day_index.run(spark, events, out, f"{tmp_path}/mark")
    assert first == {"batches": 1, "events": 4, "months": 2, "rows": 2}
    assert index(spark, out) == {("user7", "2024-01"): (2, "2024-01-05,2024-01-31", 3, "a,b"), ("user7", "2024-02"): (1, "2024-02-01", 1, "")}
    kept = files(f"{out}/index/month=2024-02")
    drop(spark, events, [(6, "2024-01-02 08:00:00", 7, "c"), (7, "2024-01-02 09:00:00", 8, "c")])  # late: January is open again
    assert work_day_index.run(spark, events, out, f"{tmp_path}/mark") == {"batches": 1, "events": 2, "months": 1, "rows": 2}
    after = {("user7", "2024-01"): (3, "2024-01-02,2024-01-05,2024-01-31", 4, "a,b,c"), ("user7", "2024-02"): (1, "2024-02-01", 1, ""), ("user8", "2024-01"): (1, "2024-01-02", 1, "c")}
    assert index(spark, out) == after
    assert files(f"{out}/index/month=2024-02") == kept
    held = files(out)
    assert work_day_index.run(spark, events, out, f"{tmp_path}/mark") == {"batches": 0, "events": 0, "months": 0, "rows": 0}
    assert files(out) == held and index(spark, out) == after
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == was


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    events, out = f"{tmp_path}/events", f"{tmp_path}/out"
    drop(spark, events, [(1, "2024-01-05 10:00:00", 7, "a")])
    real = work_day_index.month_index

    def broken(parts):
        raise RuntimeError("stopped between the tables")

    monkeypatch.setattr(work_day_index, "month_index", broken)
    with pytest.raises(Exception, match="stopped between"):
        work_day_index.run(spark, events, out, f"{tmp_path}/mark")
    monkeypatch.setattr(work_day_index, "month_index", real)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    work_day_index.run(spark, events, out, f"{tmp_path}/mark")
    assert index(spark, out) == {("user7", "2024-01"): (1, "2024-01-05", 1, "a")}


def test_several_batches_equal_one(spark, tmp_path):
    events = f"{tmp_path}/events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(5).write.parquet(events)
    work_day_index.run(spark, events, f"{tmp_path}/one", f"{tmp_path}/m1")
    assert work_day_index.run(spark, events, f"{tmp_path}/many", f"{tmp_path}/m2", files_per_batch=2)["batches"] == 3
    assert index(spark, f"{tmp_path}/one") == index(spark, f"{tmp_path}/many")


def plan_of(spark, tmp_path, notes, known, **more):
    spark.createDataFrame(notes, "doc_id bigint, source string, text string, lang string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/notes")
    spark.createDataFrame(known, "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/known")
    context_plan.run(spark, f"{tmp_path}/notes", f"{tmp_path}/known", f"{tmp_path}/out", **more)
    return {r["doc_id"]: (r["project"], r["status"], r["place"], r["running_tokens"], r["text"]) for r in context_plan.read_plan(spark, f"{tmp_path}/out").collect()}


def test_plan(spark, tmp_path):
    notes = [(1, "p", "oldest note here", "x"), (2, "p", "four", "x"), (3, "p", None, "x"), (4, "p", "shared keywords everywhere", "x"), (5, "p", "newest note text", "x"), (6, None, "alone one", "x"), (7, "", "alone two", "x"), (None, "p", "no id", "x")]
    known = [(1, "keywords shared"), (2, None), (None, "newest note text")]
    want = {
        5: ("p", "load", 1, 4, "newest note text"), 4: ("p", "routed", None, None, None), 3: ("p", "empty", None, None, None), 2: ("p", "load", 2, 5, "four"), 1: ("p", "over", 3, 9, None),
        6: ("none", "load", 2, 4, "alone one"), 7: ("none", "load", 1, 2, "alone two"),
    }
    assert plan_of(spark, tmp_path, notes, known, budget=5) == want
    assert plan_of(spark, tmp_path, notes, known, budget=5) == want
    assert plan_of(spark, tmp_path, notes[:2], known, budget=5).keys() == {1, 2}  # what is gone from the input is gone from the plan
    assert plan_of(spark, tmp_path, [], [], budget=5) == {}


def test_one_project_has_all_notes(spark, tmp_path):
    notes = [(i, "hot", "abcd" * (i % 3), "x") for i in range(3000)] + [(9999, "hot", "word " * 100_000, "x")]
    got = plan_of(spark, tmp_path, notes, [], budget=40)
    assert got[9999][1] == "over"
    used, place = 125_000, 1
    for i in range(2999, -1, -1):
        used, place = used + i % 3, place + (i % 3 > 0)
        assert got[i][1] == ("empty" if i % 3 == 0 else "over") and (i % 3 == 0 or got[i][2:4] == (place, used))


@pytest.mark.parametrize("job, inputs", [("work_day_index", {"events": "[e]vents"}), ("context_plan", {"notes": "documents", "long_term": "benchmark"})])
def test_command_line(spark, tmp_path, job, inputs):
    config = json.loads((ROOT / "jobs" / f"{job}.json").read_text()) | {k: f"/root/testdata/sf0.001/{v}.parquet" for k, v in inputs.items()}
    config["output"] = f"{tmp_path}/out"
    if "checkpoint" in config:
        config["checkpoint"] = f"{tmp_path}/mark"
    (tmp_path / "c.json").write_text(json.dumps(config))
    script = f"import sys; sys.argv=['x', {str(tmp_path / 'c.json')!r}]; sys.path.insert(0, {str(ROOT)!r}); from jobs import {job}; {job}.get_spark = lambda app: __import__('sessionlake.session', fromlist=['x']).get_spark(app, 'local[2]', 2); {job}.main(sys.argv[1])"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f" {job} " in done.stderr
    assert list((tmp_path / "out").rglob("*.parquet"))
