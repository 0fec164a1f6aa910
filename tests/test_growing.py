"""Lines of growing files: ranges cut anywhere, appended lines once after restarts, probes that read one block, and a query."""

from __future__ import annotations

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.sources import growing, transcripts
from sessionlake.streaming import ingest


class Counting(io.BytesIO):
    """A file that tells how much of it was read."""

    taken = 0

    def read(self, size=-1):
        got = super().read(size)
        self.taken += len(got)
        return got


def whole(data):
    out, at = [], 0
    for line in data.split(b"\n"):
        out.append((at, line))
        at += len(line) + 1
    return out if out[-1][1] else out[:-1]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_ranges_give_every_line_once(block):
    rng = random.Random(1)
    for _ in range(60):
        data = b"\n".join(b"x" * rng.randrange(0, 9) for _ in range(rng.randrange(0, 8))) + b"\n" * rng.randrange(0, 3)
        cuts = sorted({0, len(data), *(rng.randrange(0, len(data) + 1) for _ in range(4))})
        got = [row for lo, hi in zip(cuts, cuts[1:], strict=False) for row in growing.lines_between(io.BytesIO(data), lo, hi, block)]
        assert got == whole(data), (data, cuts)
        ended = growing.whole_lines(io.BytesIO(data), len(data), 0, block)
        assert ended == data.rfind(b"\n") + 1


def test_a_probe_reads_one_block_of_any_file():
    for size in (10, 10**6, 10**7):
        handle = Counting(b'{"cwd": "/a"}\n' + b"y" * size)
        assert next(growing.lines_between(handle, 0, 1, 1 << 14)) == (0, b'{"cwd": "/a"}')
        assert handle.taken <= 1 << 14
    handle = Counting(b"a\n" * 10**6)
    assert growing.whole_lines(handle, 2 * 10**6, 10**6) == 2 * 10**6 and handle.taken <= growing.BLOCK


def test_ranges_are_bounded_and_cover():
    sizes = {"a": (5, 1000), "b": (0, 3), "c": (0, 2), "d": (7, 7)}
    groups = growing.ranges(sizes, 100)
    assert all(sum(hi - lo for _, lo, hi in g) <= 100 for g in groups)
    assert sum(hi - lo for g in groups for _, lo, hi in g) == 1000 and all(p != "d" for g in groups for p, _, _ in g)


def rows(df):
    return sorted((r["path"].rsplit("/", 1)[-1], r["start"], r["line"]) for r in df.collect())


def test_batch(spark, tmp_path):
    growing.register(spark)
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "a.jsonl").write_bytes(b"one\r\n\n\xff\xc3\xa9\nlast")
    (tmp_path / "p" / "q" / "deep.jsonl").write_bytes(b"deep\n")
    (tmp_path / "p" / "_x.jsonl").write_bytes(b"hidden\n")
    (tmp_path / "p" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "p" / "big.jsonl").write_bytes(b"z" * 500 + b"\n" + b"w" * 5 + b"\n")
    read = spark.read.format("growing_lines").option("path", f"file://{tmp_path}")
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 5, ""), ("a.jsonl", 6, "�é"), ("a.jsonl", 10, "last"), ("big.jsonl", 0, "z" * 500), ("big.jsonl", 501, "w" * 5)]
    assert rows(read.option("depth", 2).load()) == want
    cut = read.option("depth", 2).option("splitBytes", 20).load()
    assert rows(cut) == want and cut.rdd.getNumPartitions() > 10
    assert rows(read.option("depth", 0).load())[-1] == ("deep.jsonl", 0, "deep")
    assert rows(read.option("depth", 2).option("first", True).load()) == [want[0], want[4]]
    assert rows(spark.read.format("growing_lines").option("path", f"{tmp_path}/none").load()) == []


def test_appended_lines_come_once_after_restarts(spark, tmp_path):
    folder, table, mark = tmp_path / "t", f"{tmp_path}/lines", f"{tmp_path}/mark"
    (folder / "p").mkdir(parents=True)
    take = lambda: rows(ingest.keep_lines(spark, str(folder), table, mark, splitBytes=4))
    (folder / "p" / "a.jsonl").write_bytes(b"one\ntwo\nhal")
    (folder / "p" / "b.jsonl").write_bytes(b"")
    first = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    assert take() == first
    assert take() == first  # nothing new, nothing again; the unfinished line waits
    with open(folder / "p" / "a.jsonl", "ab") as f:
        f.write(b"f\nthree\n")
    (folder / "p" / "c.jsonl").write_bytes(b"\nnew\n")
    second = sorted([*first, ("a.jsonl", 8, "half"), ("a.jsonl", 13, "three"), ("c.jsonl", 0, ""), ("c.jsonl", 1, "new")])
    assert take() == second
    (folder / "p" / "a.jsonl").write_bytes(b"anew\n")  # shorter: read again
    assert take() == sorted([*second, ("a.jsonl", 0, "anew")])
    batches = spark.read.parquet(table).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [1, 2, 4]


def test_a_sink_that_fails_gets_the_batch_again(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b"one\n")
    given = []

    def broken(batch, batch_id):
        given.append((batch_id, [r["line"] for r in batch.collect()]))
        if len(given) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.stream_lines(spark, str(folder), broken, f"{tmp_path}/m").awaitTermination()
    ingest.stream_lines(spark, str(folder), broken, f"{tmp_path}/m").awaitTermination()
    assert given == [(0, ["one"]), (0, ["one"])]


def test_first_lines_open_one_block(spark, tmp_path):
    for name, head, pad in (("b", {"cwd": "/x", "timestamp": "2024-01-02T03:04:05Z"}, 10), ("a", {"timestamp": "2024-01-01T00:00:00Z"}, 100_000)):
        (tmp_path / "-p").mkdir(exist_ok=True)
        (tmp_path / "-p" / f"{name}.jsonl").write_text(json.dumps(head) + "\n" + "{bad}\n" * pad)
    got = transcripts.first_lines(spark, str(tmp_path)).collect()
    assert [(r["project_hash"], r["cwd"], r["days"]) for r in got] == [("-p", "/x", ["2024-01-01", "2024-01-02"])]


def test_one_large_file_is_spread(spark, tmp_path):
    growing.register(spark)
    (tmp_path / "a.jsonl").write_bytes(b"".join(b"%d\n" % i for i in range(50_000)))
    got = spark.read.format("growing_lines").option("path", str(tmp_path)).option("splitBytes", 10_000).load()
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 3000 and got.select(F.sum(F.col("line").cast("int"))).first()[0] == sum(range(50_000))
