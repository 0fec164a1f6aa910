"""Locks that know their owner, files written by executors, and rewriting by ranges."""

from __future__ import annotations

import io
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionlake.plans import rewrite
from sessionlake.plans.rewrite import rewrite_files
from sessionlake.sources import growing, sinks


def test_a_lock_is_kept_as_long_as_its_writer_lives(spark, tmp_path):
    path = f"{tmp_path}/x"
    with sinks.locked(spark, path, stale=0.4):
        time.sleep(1.5)  # far beyond the limit, but renewed
        with pytest.raises(TimeoutError), sinks.locked(spark, path, wait=0.5, stale=0.4):
            pass
        assert str(os.getpid()) in Path(path + ".lock").read_text()
    assert not Path(path + ".lock").exists()


def test_a_lock_left_behind_is_broken(spark, tmp_path):
    path = f"{tmp_path}/x"
    Path(path + ".lock").write_text("elsewhere 1 dead")
    os.utime(path + ".lock", (time.time() - 100,) * 2)
    with sinks.locked(spark, path, wait=5, stale=10):
        assert "dead" not in Path(path + ".lock").read_text()
    assert not Path(path + ".lock").exists() and not Path(path + ".unlock").exists()


def test_only_its_own_writer_deletes_a_lock(spark, tmp_path):
    path = f"{tmp_path}/x"
    with sinks.locked(spark, path):
        Path(path + ".lock").write_text("another writer")
    assert Path(path + ".lock").read_text() == "another writer"


def test_write_files(spark, tmp_path):
    rows = [(f"file://{tmp_path}/a/b/é.txt", "é\n", 86_400_000), (f"{tmp_path}/c.txt", None, None), (f"{tmp_path}/c.txt", None, None), (f"{tmp_path}/long.txt", "x" * 3_000_000, None)]
    df = spark.createDataFrame(rows, "path string, text string, mtime bigint").repartition(3)
    assert sinks.write_files(df) == 4 and sinks.write_files(df) == 4 and sinks.write_files(df.limit(0)) == 0
    assert (tmp_path / "a/b/é.txt").read_text() == "é\n" and (tmp_path / "a/b/é.txt").stat().st_mtime == 86_400
    assert (tmp_path / "c.txt").read_text() == "" and (tmp_path / "long.txt").stat().st_size == 3_000_000
    assert not list(tmp_path.rglob("*.stage"))


@pytest.mark.parametrize("split", [1, 5, 64, 1 << 20])
def test_rewriting_equals_replace(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {f"{k}.jsonl": "".join(rng.choice(["a", "b", "ab", "\n", "\r\n", "é"]) for _ in range(40 if split < 5 else 300)) for k in range(3)} | {"none.jsonl": "xyz\n", "empty.jsonl": "", "end.jsonl": "ab", "p/deep.jsonl": "aba\nab\n"}
    (tmp_path / "p").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "other.txt").write_text("ab")
    was = (tmp_path / "none.jsonl").stat().st_mtime_ns
    found = rewrite_files(spark, str(tmp_path), ".jsonl", "ab", "[abab]", split=split)
    assert found == {n: t.count("ab") for n, t in texts.items() if "ab" in t}
    for name, text in texts.items():
        assert (tmp_path / name).read_bytes() == text.replace("ab", "[abab]").encode()
    assert (tmp_path / "other.txt").read_text() == "ab" and (tmp_path / "none.jsonl").stat().st_mtime_ns == was
    assert sorted(p.name for p in tmp_path.rglob(".*")) == []


def test_overlaps_bytes_and_refusals(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"aaaa\xff aaa\naa")
    assert rewrite_files(spark, str(tmp_path), "x.jsonl", "aa", "b", depth=1, split=3) == {"x.jsonl": 4}
    assert (tmp_path / "x.jsonl").read_bytes() == b"bb\xff ba\nb"
    for bad in ("", "a\nb"):
        with pytest.raises(ValueError):
            rewrite_files(spark, str(tmp_path), "x.jsonl", bad, "c")
    assert rewrite_files(spark, f"{tmp_path}/none", ".jsonl", "a", "b") == {}


@pytest.mark.parametrize("run", [1 << 22, 20])
def test_ranges_of_a_run_share_one_opening(spark, tmp_path, monkeypatch, run):
    """Of one run each file is opened once, however small its ranges; of several its parts come together in order."""
    opened, log = growing._Files.open, str(tmp_path / "log")

    def noted(self, path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return opened(self, path)

    monkeypatch.setattr(growing._Files, "open", noted)
    monkeypatch.setattr(rewrite, "_RUN", run)
    texts = {f"in/{k}.html": "".join(f"{'the' * (i % 3)}{i} é\n" for i in range(40 * k)) + "the" for k in (1, 2, 3)}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    assert rewrite_files(spark, str(tmp_path / "in"), ".html", "the", "a the", split=5) == {n[3:]: t.count("the") for n, t in texts.items()}
    for name, text in texts.items():
        assert (tmp_path / name).read_bytes() == text.replace("the", "a the").encode()
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["1.html", "2.html", "3.html"]
    n = len(open(log).readlines())
    assert n == 3 if run > 20 else n == 2 * sum(-(-len(t.encode()) // 20) for t in texts.values())


def test_a_range_within_a_line_reads_no_further():
    handle = io.BytesIO(b"x" * 100_000 + b"\ny\n")
    assert list(growing.lines_between(handle, 10, 20, block=16)) == [] and handle.tell() < 50
    assert list(growing.lines_between(handle, 100_001, 100_003, block=16)) == [(100_001, b"y")]


def test_an_extract_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def noted(n):
        seen.add(1)
        return n

    rows = [("2024-02-03", "-p", f"s{i}", 1, [(1, "assistant", f"text {i}")]) for i in range(5)]
    extracted = spark.createDataFrame(rows, "date string, project_hash string, session_id string, n bigint, messages array<struct<line_no:bigint,role:string,content:string>>")
    extracted = extracted.select("date", "project_hash", "session_id", F.lit("2024-02-03").cast("timestamp").alias("file_mtime"), noted("n").alias("message_count"), "messages")
    assert sinks.write_extract(spark, extracted, f"{tmp_path}/x.txt", f"{tmp_path}/x.sessions", 100) == 5
    assert seen.value == 5 and "(5 sessions, 5 messages)" in (tmp_path / "x.txt").read_text()
