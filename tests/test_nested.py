"""Documents merged and pruned, against plain recursion."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import nested


def merged(a, b, arrays, path=()):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merged(a[k], b[k], arrays, (*path, k)) if k in a and k in b else a.get(k) if k in a else b[k] for k in a | b}
    if isinstance(a, list) and isinstance(b, list) and any(len(p) == len(path) and all(x in (None, y) for x, y in zip(p, path, strict=True)) for p in arrays):
        out, known = list(a), [json.dumps(x, sort_keys=True) for x in a]
        for x in b:
            if json.dumps(x, sort_keys=True) not in known:
                out.append(x)
                known.append(json.dumps(x, sort_keys=True))
        return out
    return b


def some(rng, depth):
    kind = rng.random()
    if depth and kind < 0.6:
        return {k: some(rng, depth - 1) for k in rng.sample(["a", "b", 'q"\\', "é", "list"], rng.randint(0, 4))}
    if kind < 0.8:
        return [rng.choice([1, "x", None, {"m": 1, "c": ["y"]}]) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, 3, 2.5, "", "text", '{"a":1}'])


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string").withColumn("path", F.lit("clash")).withColumn("v", F.lit(1)).repartition(3)


def read(rows):
    return {r.id: json.loads(r.text) for r in rows.collect()}


@pytest.mark.parametrize("arrays", [[], [("list",), (None, "list")]])
def test_merge(spark, arrays):
    rng = random.Random(5)
    a, b = ({i: some(rng, 4) for i in rng.sample(range(40), 30)} for _ in range(2))
    got = read(nested.merge_documents(*(frame(spark, [(i, json.dumps(v)) for i, v in s.items()]) for s in (a, b)), arrays=arrays))
    assert got == {i: merged(a[i], b[i], arrays) if i in a and i in b else a.get(i) if i in a else b[i] for i in a | b}


def test_merge_edges(spark):
    base = [(1, '{"a":1}'), (1, '{"b":1}'), (2, None), (3, "no json"), (4, ""), (None, '{"x":{"y":1}}'), (5, "{}"), (6, '{"k":{"deep":1}}')]
    new = [(2, '{"c":[2,1]}'), (3, "7"), (None, '{"x":{"z":null}}'), (5, "{}"), (6, '{"k":null}'), (6, '{"k":null}')]
    got = nested.merge_documents(frame(spark, base), frame(spark, new))
    assert got.columns == ["id", "text"]
    assert read(got) == {1: {"b": 1}, 2: {"c": [2, 1]}, 3: 7, None: {"x": {"y": 1, "z": None}}, 5: {}, 6: {"k": None}}
    none = frame(spark, base).limit(0)
    assert nested.merge_documents(none, none, [("a",)]).count() == 0
    assert nested.remove_elements(none, [("a",)], lambda e: F.array(F.to_json(e)), ["x"]).count() == 0


def test_one_large_document(spark):
    """All keys in one document."""
    a, b = ({"days": {str(i): {"n": s, "list": [i, s]} for i in range(s, 3000 + s)}} for s in (0, 1000))
    got = read(nested.merge_documents(frame(spark, [(1, json.dumps(a))]), frame(spark, [(1, json.dumps(b))]), [("days", None, "list")]))
    assert got == {1: merged(a, b, [("days", None, "list")])} and got[1]["days"]["2000"] == {"n": 1000, "list": [2000, 0, 1000]}


def test_remove(spark):
    entry = lambda m, *c: {"matcher": m, "hooks": [{"command": x} for x in c]}
    docs = [
        (1, {"hooks": {"Start": [entry("a", "run old.py"), entry("b", "keep"), entry("a", "keep", "x old.py y")], "Stop": [entry("", "old.py")], "Other": {"k": {}}}, "n": 1}),
        (2, {"hooks": {"Start": [entry("a", "old.py")]}}),
        (3, {"hooks": {"Start": [{"matcher": "none"}, 5, None]}, "empty": {}}),
        (4, {"hooks": {"Start": []}, "list": ["old.py"]}),
        (None, 8),
    ]
    commands = lambda e: F.transform(F.try_variant_get(e, "$.hooks", "array<variant>"), lambda h: F.try_variant_get(h, "$.command", "string"))
    rows = nested.remove_elements(frame(spark, [(i, json.dumps(d)) for i, d in docs] + [(5, None)]), [("hooks", None)], commands, ["old.py", "older"])
    got = {r.id: (json.loads(r.text), r.n_removed) for r in rows.collect()}
    assert got == {
        1: ({"hooks": {"Start": [entry("b", "keep")], "Other": {"k": {}}}, "n": 1}, 3),
        2: ({}, 1),
        3: ({"hooks": {"Start": [{"matcher": "none"}, 5, None]}, "empty": {}}, 0),
        4: ({"list": ["old.py"]}, 0),
        None: (8, 0),
    }


def test_merging_has_more_tasks_for_more_text(spark, monkeypatch):
    """Partitions follow the documents' size, and small ones aren't put together again."""
    monkeypatch.setattr(nested, "TASK_BYTES", 500, raising=False)
    a, b = ({i: {"log": [{"at": f"{s}{i}"}], "days": {str(d): {"n": d} for d in range(s, 5 + s)}} for i in range(40)} for s in (0, 2))
    rows = nested.merge_documents(*(frame(spark, [(i, json.dumps(v)) for i, v in s.items()]) for s in (a, b)), [("log",)])
    assert read(rows) == {i: merged(a[i], b[i], [("log",)]) for i in a}
    assert rows.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism - 1


def test_pruning_has_more_tasks_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(nested, "TASK_BYTES", 500, raising=False)
    docs = [(i, json.dumps({"log": [{"at": f"day {d}"} for d in range(5)], "n": i})) for i in range(40)]
    rows = nested.remove_elements(frame(spark, docs), [("log",)], lambda e: F.array(F.to_json(e)), ["day 3"])
    assert {r.id: (json.loads(r.text), r.n_removed) for r in rows.collect()} == {i: ({"log": [{"at": f"day {d}"} for d in (0, 1, 2, 4)], "n": i}, 1) for i in range(40)}
    assert rows.rdd.getNumPartitions() == -(-sum(len(d) for _, d in docs) // 500) > 4


def test_roots_are_joined_in_more_tasks_for_more_text(spark, monkeypatch):
    """The first level too is dealt out by the documents' size, though all its rows have one path."""
    saved, save = [], nested.Scratch.save
    monkeypatch.setattr(nested, "TASK_BYTES", 500)
    monkeypatch.setattr(nested.Scratch, "save", lambda self, df, name: saved.append((name, save(self, df, name))) or saved[-1][1])
    a, b = ({i: {"days": {str(d): {"n": d} for d in range(s, 5 + s)}} for i in range(200)} for s in (0, 2))
    rows = nested.merge_documents(*(frame(spark, [(i, json.dumps(v)) for i, v in s.items()]) for s in (a, b)))
    assert read(rows) == {i: merged(a[i], b[i], []) for i in a}
    tasks = [len(df.inputFiles()) for name, df in saved if name == "level"]
    assert len(tasks) == 4 and min(tasks) > 4 * spark.sparkContext.defaultParallelism, tasks
