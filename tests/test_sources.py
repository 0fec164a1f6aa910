"""A memory tree on disk: scans, context, lifecycle, incremental ingest."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import settings
from sessionlake.operators import index, merge
from sessionlake.plans import context, lifecycle
from sessionlake.session import Layout
from sessionlake.sources import text as files
from sessionlake.sources import transcripts
from sessionlake.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text), "utf-8")


@pytest.fixture
def tree(tmp_path):
    say = lambda role, text: json.dumps({"type": role, "message": {"role": role, "content": text}})
    big = "word " * 300
    work = tmp_path / "work" / "Proj"
    work.mkdir(parents=True)
    write(tmp_path / "projects/-p/s1.jsonl", "\n".join([json.dumps({"cwd": str(work), "timestamp": "2026-02-01T10:00:00Z"}), say("user", "hi"), say("assistant", big), "{bad", "17", say("assistant", "<system-reminder>")]))
    write(tmp_path / "projects/-p/s2.jsonl", say("assistant", [{"type": "text", "text": big}]))
    write(tmp_path / "projects/-p/s1-subagent.jsonl", say("assistant", big))
    write(tmp_path / "projects/-p/small.jsonl", say("assistant", "x"))
    write(tmp_path / "projects/-q/s3.jsonl", say("user", big))
    write(tmp_path / "projects/-p/sessions-index.json", {"originalPath": "", "entries": [{"sessionId": "s1", "created": "bad"}, {"sessionId": "s1", "created": "2026-02-01T23:30:00-05:00", "projectPath": "/x"}]})
    write(tmp_path / "projects/-q/sessions-index.json", "{bad")
    write(tmp_path / "memory/.captured", "s2\n\n s2 \r\nold\n")
    write(tmp_path / "memory/projects-index.json", {"projects": {str(work).lower(): {"name": "Proj", "originalPath": str(work), "encodedPaths": ["-p"], "workDays": ["2026-02-01"]}, "/gone": {"name": "Gone", "originalPath": "/gone", "encodedPaths": ["-g"], "workDays": []}}})
    write(tmp_path / "memory/global-long-term-memory.md", "## Pinned\n- é\n")
    write(tmp_path / "memory/project-memory/proj-long-term-memory.md", "## Pinned\n- p\n")
    for d in ("01", "02", "03"):
        write(tmp_path / f"memory/daily/2026-02-{d}.md", f"# 2026-02-{d}\n## Actions\n- [global/implement] g{d}\r\n- [proj/implement] p{d}\n")
    write(tmp_path / "memory/.backups/20260101_000000/a.md", "x")
    return Layout(str(tmp_path)), work


def test_sessions(spark, tree):
    layout, _ = tree
    rows = {r.session_id: r for r in transcripts.list_sessions(spark, layout.projects).collect()}
    assert set(rows) == {"s1", "s2", "small", "s3"}
    assert rows["s1"].created == "2026-02-01T23:30:00-05:00" and rows["s1"].file_size > 1000
    lines = transcripts.read_lines(spark, layout.projects)
    assert {r.session_id for r in transcripts.assistant_sessions(lines).collect()} == {"s1", "s2", "small", "s1-subagent"}
    said = transcripts.messages(lines).where("session_id = 's1'").collect()
    assert len(said) == 1 and said[0].role == "assistant" and said[0].content.startswith("word")
    first = {r.project_hash: r for r in transcripts.first_lines(spark, layout.projects).collect()}
    assert first["-p"].days == ["2026-02-01"] and first["-p"].cwd.endswith("Proj") and first["-q"].cwd is None
    assert {r.original_path for r in transcripts.original_paths(transcripts.read_sessions_indexes(spark, layout.projects)).collect()} == set()


def test_extract(spark, tree):
    layout, _ = tree
    got = context.day_extract(spark, layout).collect()
    assert [(r.session_id, r.date, r.message_count) for r in got] == [("s1", "2026-02-01", 1)]
    assert context.day_extract(spark, layout, exclude="s1").count() == 0


def test_text_sources(spark, tree):
    layout, _ = tree
    assert sorted(r[0] for r in files.read_ledger(spark, layout.captured).collect()) == ["old", "s2"]
    assert files.read_ledger(spark, layout.captured + "-none").count() == 0
    row = files.document_size(spark, layout.global_memory, "g").first()
    assert (row.text, row.bytes) == ("## Pinned\n- é\n", 15)
    assert files.document_size(spark, layout.memory + "/none.md", "g").first().bytes == 0
    assert [(r.backup, r.files) for r in files.list_backups(spark, layout.backups).collect()] == [("20260101_000000", ["a.md"])]


def test_context(spark, tree):
    layout, work = tree
    own = settings.parse_settings(None)
    project = context.current_project(spark, layout, str(work), own)
    assert project == "Proj"
    parts = context.components(spark, layout, own, project)
    texts = [r.text for r in context.context(parts, own["totalTokenBudget"]).collect()]
    assert len(texts) == 4 and texts[2].index("g03") < texts[2].index("g02") and "g01" not in texts[2] and texts[3].index("p01") < texts[3].index("p03")
    assert "over budget" in context.context(parts, 1).collect()[-1].text
    assert context.synthesis_due(spark, layout, F.lit("2026-02-12 00:00:00").cast("timestamp"), own) is True
    assert "limit 105 lines" in context.synthesis_prompt(["2026-02-01"], ["Proj"], {"2026-02-01": ("/tmp/x", 5)})


def test_index(spark, tree):
    layout, work = tree
    projects = transcripts.read_projects_index(spark, layout.projects_index)
    existing = spark.createDataFrame([(str(work),)], "path string")
    assert [r.name for r in index.stale(projects, existing).collect()] == ["Gone"]
    held = spark.createDataFrame([("proj-long-term-memory.md",)], "file string")
    got = {r.name: (r.path_exists, r.has_memory_file, r.issues) for r in index.statuses(projects, existing, held).collect()}
    assert got == {"Proj": (True, True, []), "Gone": (False, False, ["path missing: /gone"])}
    assert [r.file for r in index.work_days_by_file(projects).orderBy("file").collect()] == ["gone-long-term-memory.md", "proj-long-term-memory.md"]
    lines = transcripts.read_lines(spark, layout.projects).where("project_hash = '-p'")
    found = files.read_whole(spark, f"{layout.projects}/-p/*.jsonl").select(F.col("stem").alias("session_id"), "path", "mtime")
    assert {r.firstPrompt for r in merge.rebuild_index(found, lines, "/x").collect()} == {"(recovered session)"}


def test_lifecycle(spark, tree, tmp_path):
    layout, work = tree
    old, new = str(work), str(tmp_path / "work" / "New")
    assert lifecycle.allowed(lifecycle.check_move(spark, layout, old, new))
    found = lifecycle.check_move(spark, layout, "/nope", "/nope/too/deep")
    assert not lifecycle.allowed(found) and {f.code for f in found} == {"no-source", "no-parent"}
    assert [f.code for f in lifecycle.check_move(spark, layout, old, old)] == ["target-exists"]
    (tmp_path / "projects" / lifecycle.encode(old)).mkdir()
    plan = lifecycle.plan_move(spark, layout, old, new)
    assert len(plan.of("move")) == 1 and plan.of("register")[0].value["workDays"] == ["2026-02-01"]
    with pytest.raises(PermissionError):
        lifecycle.carry_out(spark, layout, plan)
    write(tmp_path / "history.jsonl", f"{work} {work}\n")
    write(tmp_path / "projects/-r/sessions-index.json", {"originalPath": f"{work}/sub"})
    before = (tmp_path / "projects/-p/sessions-index.json").stat().st_mtime_ns
    done = lifecycle.carry_out(spark, layout, plan, confirmed=True, rewrite=(old, new))
    assert done["replaced"] == 2 and done["indexes"] == 1 and (tmp_path / "projects/-p/sessions-index.json").stat().st_mtime_ns == before
    assert json.loads((tmp_path / "projects/-r/sessions-index.json").read_text())["originalPath"] == f"{new}/sub"
    read = lambda: json.loads(Path(layout.projects_index).read_text())["projects"]
    assert new.lower() in read() and (tmp_path / "projects" / lifecycle.encode(new)).is_dir()
    orphan = lifecycle.plan_merge(spark, layout, "-g", new)
    assert orphan.of("forget")[0].source == "/gone" and orphan.of("extend")[0].value == []
    clean = lifecycle.plan_cleanup(spark, layout)
    assert "/gone" in [a.source for a in clean.of("forget")] and clean.counts()["back_up"] == 1
    lifecycle.carry_out(spark, layout, clean, confirmed=True)
    assert "/gone" not in read()
    assert lifecycle.memory_name("My  Project_1") == "my-project1-long-term-memory.md"
    pair = lifecycle.memory_pair(spark, layout, "Proj", "Nope")
    assert pair["source_exists"] and not pair["dest_exists"]
    assert lifecycle.plan_move(spark, layout, new, new, "abort").of("merge", "move") == []


def test_ingest(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "session_id string, date string")
    captured, out = spark.createDataFrame([("z",)], "session_id string"), {}
    ingest.process_once(frame([("a", "2026-02-11"), ("b", "2026-02-12")]), captured, lambda df: out.update(sink=df.count()), lambda df: out.update(ids=sorted(r[0] for r in df.collect())), F.lit("2026-02-12"))
    assert out == {"sink": 2, "ids": ["a", "z"]}
    assert ingest.reopen(captured, "z", spark).count() == 0
    with pytest.raises(RuntimeError):
        ingest.process_once(frame([("a", "2026-02-11")]), captured, lambda df: (_ for _ in ()).throw(RuntimeError()), lambda df: out.update(ids=None), F.lit("x"))
    assert out["ids"] == ["a", "z"]


def test_stream(spark, tmp_path):
    drop, seen = str(tmp_path / "drop"), []
    rows = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (1, "2026-01-01 11:00:00"), (2, "2026-01-09 00:00:00")], "user_id bigint, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(drop)
    for _ in range(2):
        ingest.stream_drops(spark, drop, "user_id bigint, ts timestamp", lambda df: df, lambda df, _: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 3
    assert {(r.user_id, str(r.day), r.events) for r in ingest.daily_activity(rows).collect()} == {(1, "2026-01-01", 2), (2, "2026-01-09", 1)}


def test_sinks(spark, tree, tmp_path):
    from sessionlake.operators import pending
    from sessionlake.sources import sinks

    layout, _ = tree
    got = context.day_extract(spark, layout)
    out, side = str(tmp_path / "x.txt"), str(tmp_path / "x.ids")
    assert sinks.write_extract(spark, got, out, side, pending.DAY_LINE_BUDGET) == 1
    assert "Session: s1" in (tmp_path / "x.txt").read_text() and (tmp_path / "x.ids").read_text() == "s1\n"
    assert sinks.write_extract(spark, got, out, side, as_json=True) == 1
    assert json.loads((tmp_path / "x.txt").read_text())["2026-02-01"][0]["session_id"] == "s1"
    assert sinks.write_extract(spark, got.limit(0), str(tmp_path / "none"), side) == 0 and not (tmp_path / "none").exists()
    assert sinks.write_ledger(spark, layout.captured, files.read_ledger(spark, layout.captured).unionByName(spark.createDataFrame([("a",)], "session_id string")))
    assert [r[0] for r in files.read_ledger(spark, layout.captured).orderBy("session_id").collect()] == ["a", "old", "s2"]
    assert sinks.save_settings(spark, layout.settings, {"decay": {"ageDays": 9}}) and settings.load_settings(spark, layout.settings)["decay"]["ageDays"] == 9
    assert not sinks.save_json(spark, "/proc/no/such.json", {})
    sinks.write_documents(spark.createDataFrame([("a.md", "x\ny\n"), ("b.md", "z")], "file string, text string"), str(tmp_path / "docs"))
    assert {r.value for r in files.read_whole(spark, str(tmp_path / "docs/*/*.txt")).collect()} == {"x\ny\n", "z\n"}
    flags = pending.captured_flags(transcripts.list_sessions(spark, layout.projects), files.read_ledger(spark, layout.captured))
    assert {r.session_id: r.captured for r in flags.collect()} == {"s1": False, "s2": True, "small": False, "s3": False}


def test_decay_run(spark, tree):
    import datetime as dt

    from sessionlake.plans import maintenance

    layout, _ = tree
    note = lambda *days: "## Key Learnings\n" + "".join(f"- ({d}) [x] {d}\n" for d in days)
    sinks_text = {layout.global_memory: note("2026-01-01", "2026-02-10"), f"{layout.project_memory}/proj-long-term-memory.md": note("2026-01-31", "2025-01-01"), f"{layout.project_memory}/gone-long-term-memory.md": note("2025-01-01"), layout.archive: "# Decay Archive\n\n## Archived 2026-02-12\n- today\n\n## Archived 2024-01-01\n- old\n"}
    for path, text in sinks_text.items():
        write(Path(path), text)
    own = settings.set_value(settings.parse_settings(None), "decay.projectWorkingDays", 1)
    day = dt.date(2026, 2, 12)
    assert maintenance.run_decay(spark, layout, own, day, dry_run=True) == {"archived": 4, "purged": 1}
    assert files.read_document(spark, layout.global_memory) == sinks_text[layout.global_memory]
    assert maintenance.run_decay(spark, layout, own, day) == {"archived": 4, "purged": 1}
    archive = files.read_document(spark, layout.archive)
    assert archive.count("## Archived") == 1 and archive.count("Source:") == 4 and "- today" in archive and "- old" not in archive
    assert files.read_document(spark, layout.global_memory) == "## Key Learnings\n- (2026-02-10) [x] 2026-02-10\n"
    assert files.read_document(spark, f"{layout.project_memory}/proj-long-term-memory.md") == "## Key Learnings\n"
    assert maintenance.run_decay(spark, layout, own, day) == {"archived": 0, "purged": 0}


def test_build_index(spark, tree):
    from sessionlake.plans import maintenance

    layout, work = tree
    doc = maintenance.build_index(spark, layout)
    assert doc["projects"] == {str(work).lower(): {"name": "Proj", "originalPath": str(work), "encodedPaths": ["-p"], "workDays": ["2026-02-01"]}}
    assert files.read_document(spark, layout.projects_index)


def test_reports(spark, tree):
    from sessionlake.plans import report

    layout, work = tree
    got = {r.metric: r.value for r in report.memory_status(spark, layout).collect()}
    assert got == {"daily_notes": "3", "first_day": "2026-02-01", "last_day": "2026-02-03", "project_notes": "1", "sessions": "4", "captured": "1", "pending": "1", "pending_days": "1"}
    got = {r.metric: r.value for r in report.token_usage(spark, layout, settings.parse_settings(None), str(work)).collect()}
    assert got["project_name"] == "Proj" and got["global_short_days_actual"] == "2" and got["project_short_days_actual"] == "3"
    assert got["global_long_term_tokens"] == str(15 // 4) and int(got["total_tokens"]) == sum(int(got[f"{c}_tokens"]) for c in ("global_long_term", "global_short_term", "project_long_term", "project_short_term"))


def test_merge_orphan(spark, tree, tmp_path):
    layout, work = tree
    target = tmp_path / "projects" / lifecycle.encode(str(work))
    found = lifecycle.check_merge(spark, layout, "-q", str(work))
    assert lifecycle.allowed(found) and [f.code for f in found] == ["target-empty"]
    assert not lifecycle.allowed(lifecycle.check_merge(spark, layout, "-nope", "/nope"))
    write(target / "s3.jsonl", "kept")
    doc = json.loads(Path(layout.projects_index).read_text())
    doc["projects"]["/old"] = {"name": "Old", "originalPath": "/old", "encodedPaths": ["-q"], "workDays": ["2026-02-01", "2026-02-09"]}
    write(Path(layout.projects_index), doc)
    write(tmp_path / "projects/-q/new.jsonl", json.dumps({"type": "human", "message": {"content": "p" * 200}}) + "\n")
    os.utime(tmp_path / "projects/-q/new.jsonl", (1_700_000_000, 1_700_000_000))
    plan = lifecycle.plan_merge(spark, layout, "-q", str(work))
    assert [(a.kind, a.source, a.value) for a in plan.of("forget", "extend")] == [("forget", "/old", None), ("extend", str(work).lower(), ["2026-02-09"])]
    done = lifecycle.carry_out(spark, layout, plan, confirmed=True)
    assert (target / "s3.jsonl").read_text() == "kept" and (target / "new.jsonl").stat().st_mtime == 1_700_000_000
    assert (tmp_path / "projects/-q.merged.bak").is_dir() and not (tmp_path / "projects/-q").exists()
    projects = json.loads(Path(layout.projects_index).read_text())["projects"]
    assert projects[str(work).lower()]["workDays"] == ["2026-02-01", "2026-02-09"] and "/old" not in projects
    entries = {e["sessionId"]: e for e in json.loads((target / "sessions-index.json").read_text())["entries"]}
    assert set(entries) == {"s3", "new"} and entries["new"]["firstPrompt"] == "p" * 150 and entries["s3"]["firstPrompt"] == "(recovered session)"
    assert entries["new"]["projectPath"] == str(work) and entries["new"]["fullPath"] == str(tmp_path / "projects/-q/new.jsonl") and entries["new"]["created"] == "2023-11-14T22:13:20Z"
    write(tmp_path / "other" / "sessions-index.json", {"entries": [{"id": "s3", "modified": "2999"}, {"sessionId": "z"}, {}]})
    assert lifecycle.merge_indexes(spark, str(tmp_path / "other"), str(target), str(work), replace=False) == 1
    assert lifecycle.merge_indexes(spark, str(tmp_path / "other"), str(target), str(work), replace=True) == 1
    assert set(lifecycle.restore(spark, layout, Path(done["backup"]).name)) == {layout.projects_index, f"{layout.project_memory}/proj-long-term-memory.md"}
    assert "/old" in json.loads(Path(layout.projects_index).read_text())["projects"]
    same = lifecycle.plan_merge(spark, layout, lifecycle.encode(str(work)), str(work))
    assert not same.of("move", "merge", "copy", "retire")


def test_listing_opens_no_file(spark, tmp_path):
    """A file far larger than memory is listed from the folder alone."""
    (tmp_path / "projects/-big").mkdir(parents=True)
    with (tmp_path / "projects/-big/s.jsonl").open("w") as f:
        f.truncate(1 << 40)
    row = transcripts.list_sessions(spark, str(tmp_path / "projects")).first()
    assert (row.session_id, row.file_size) == ("s", 1 << 40)


def test_lines_of_split_files(spark, tmp_path):
    """Numbers rise within a file that is read in many splits."""
    (tmp_path / "t").mkdir()
    for name in "ab":
        (tmp_path / f"t/{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_numbered(spark, str(tmp_path / "t/*.jsonl")).orderBy("name", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == [f"{name}{i}" for name in "ab" for i in range(3000)]
    assert len({(r.name, r.line_no) for r in rows}) == 6000
    assert files.read_numbered(spark, str(tmp_path / "none*")).count() == files.read_numbered(spark, []).count() == 0


def test_ledger_lock(spark, tree):
    from sessionlake.sources import sinks

    layout, _ = tree
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "session_id string")
    with sinks.locked(spark, layout.captured), pytest.raises(TimeoutError), sinks.locked(spark, layout.captured, wait=0.2):
        pass
    lock = Path(layout.captured + ".lock")
    lock.touch()
    os.utime(lock, (1, 1))
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda n: sinks.add_captured(spark, layout.captured, ids(n)), ["n1", "n2", "n3", "n4"]))
    assert not lock.exists()
    assert sinks.remove_captured(spark, layout.captured, ids("n1")) and not sinks.remove_captured(spark, layout.captured, ids("n1"))
    assert sorted(r[0] for r in files.read_ledger(spark, layout.captured).collect()) == ["n2", "n3", "n4", "old", "s2"]


def test_session_start(spark, tree, tmp_path):
    layout, work = tree
    own, now = settings.parse_settings(None), datetime(2026, 2, 12, 9, 30, tzinfo=timezone(timedelta(hours=2)))
    rows = context.session_start(spark, layout, own, str(work), now, session_id="s2", resumed=True, extracts=str(tmp_path / "out")).collect()
    assert rows[0].text == "Current time: 2026-02-12 09:30 (UTC+0200)"
    prompt = rows[1].text
    assert "Pending days: 1 (2026-02-01)" in prompt and f"read {tmp_path}/out/extract-2026-02-01.txt (limit" in prompt and "extract-2026-02-01.sessions" in prompt and "Model: default." in prompt and "global, Gone, Proj" in prompt
    assert (tmp_path / "out/extract-2026-02-01.sessions").read_text() == "s1\n"
    assert [r.text.split("\n")[0] for r in rows[2:]] == ["## Global Long Term", "## Project Long Term", "## Global Short Term", "## Project Short Term"]
    assert sorted(r[0] for r in files.read_ledger(spark, layout.captured).collect()) == ["old"]
    write(Path(layout.last_synthesis), "2026-02-12T07:00:00+00:00")
    rows = context.session_start(spark, layout, own, "/elsewhere", now, session_id="s1").collect()
    assert [r.ord for r in rows] == [0, 2, 4]
    assert "without session s1" in context.synthesis_prompt(["2026-02-01"], [], exclude="s1")


def test_day_sessions(spark, tree, tmp_path):
    from sessionlake.plans import report

    layout, _ = tree
    got = report.day_sessions(spark, layout, "2026-02-01").collect()
    assert [(r.session_id, r.captured, r.message_count, r.previews[0][:20]) for r in got] == [("s1", False, 1, "ASSISTANT: word word")]
    for name, text in (("a/x", "1"), ("a/y", "2"), ("a/z", "3"), ("b/x", "1"), ("b/y", "9")):
        write(tmp_path / name, text)
    assert [tuple(r) for r in report.compare_folders(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == [("x", "same"), ("y", "different"), ("z", "missing")]


def test_a_pattern_takes_files_of_its_depth(spark, tmp_path):
    for name in ("a/x.txt", "a/k=v/y.txt", "b/z.txt", "b/z.md", "top.txt", "a/_h.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "c.txt").mkdir()
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        for pattern, want in (("*/*.txt", {"a/x.txt", "b/z.txt"}), ("*.txt", {"top.txt"}), ("*/z.*", {"b/z.txt", "b/z.md"}), ("*/x.txt", {"a/x.txt"}), ("{a,b}/[xz].txt", {"a/x.txt", "b/z.txt"}), ("none/*.txt", set())):
            assert {r.value for r in files.read_whole(spark, f"{root}/{pattern}").collect()} == want
            assert {r.path.split(f"{tmp_path}/")[1] for r in files.list_files(spark, f"{root}/{pattern}").collect()} == want
