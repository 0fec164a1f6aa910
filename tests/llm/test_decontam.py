from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from helpers import docs, empty, lower
from oracle import connect, same

from sessionlake.llm import decontam, queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = tokens(t), set(), set()
        for item, x in items:
            p = tokens(x)
            for i in range(max(len(p) - 9, 1) if p else 0):
                q = p[i : i + 10]
                for s in range(len(w) - len(q) + 1):
                    if w[s : s + len(q)] == q:
                        hit.update(range(s, s + len(q)))
                        ids |= {str(item)} if item is not None else set()
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


def test_oracle(spark):
    same(queries.op4_decontaminate(spark, SF), connect(SF), queries.OP4_SQL)


def test_brute_force(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice(["a", "B", "É", "c7", "dd"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 9, 10, 11, 14]))) for i in range(6)] + [(10, None), (11, "..."), (None, "zz zz zz zz"), (2, make(10))]
    rows = [(i, "-".join([make(rng.randint(0, 12)), rng.choice(items)[1] or "", make(rng.randint(0, 12))])) for i in range(60)]
    rows += [(100, None), (101, "!"), (3, rows[3][1]), (3, "other text"), (None, items[4][1]), (102, "zz zz zz zz zz zz")]
    frame = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, pid string")
    got = decontam.contamination(docs(spark, rows), frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got), key=repr) == brute(rows, items)
    assert decontam.contamination(empty(spark), frame).count() == 0
    clean = decontam.contamination(docs(spark, rows), frame.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.n_hit for r in clean)


def near_phrases(rows, items, slop):
    """For each row the phrases that it has in some order within slop words more, and not as they are."""
    phrases = {tuple(p[i : i + 10]) for _, x in items for p in [tokens(x)] for i in range(max(len(p) - 9, 1) if p else 0)}
    out = []
    for d, t in rows:
        w, n = tokens(t), 0
        for p in phrases:
            spans = [Counter(w[s : s + len(p) + slop]) for s in range(max(len(w) - len(p) - slop, 0) + 1)]
            n += any(not Counter(p) - c for c in spans) and all(tuple(w[s : s + len(p)]) != p for s in range(len(w)))
        out.append((d, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [100_000, 2])
def test_proximity(spark, monkeypatch, block):
    """Width and multiplicity count; terms in many blocks give the same."""
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    rows = [(1, "x alpha beta gamma delta y"), (2, "delta alpha x gamma beta"), (3, "alpha beta gamma"), (4, "alpha " + "x " * 30 + "beta gamma delta"), (5, "alpha x x x gamma beta delta"), (6, "beta alpha delta gamma")]
    _, found = decontam.matches(docs(spark, rows), items, slop=2)
    assert {(r.doc_id, r.kind) for r in found.collect()} == {(1, "phrase"), (2, "near"), (6, "near")}
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(i, make(rng.choice([2, 3, 4, 5]))) for i in range(5)] + [(9, "a a b"), (10, make(11)), (11, "zz zz")]
    rows = [(i, make(rng.randint(0, 25))) for i in range(60)] + [(100, "a b x"), (101, "b a x a"), (102, "zz y y zz"), (103, "zz y y y zz"), (None, "a b a"), (None, None)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(docs(spark, rows), frame, slop=2).collect()
    assert sorted(((r.doc_id, r.n_near) for r in got), key=repr) == near_phrases(rows, items, 2)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got), key=repr) == brute(rows, items)


def test_no_text_is_shuffled(spark, monkeypatch):
    """Below every exchange, arrays of words are no longer than the words around a posting."""
    monkeypatch.setattr(decontam, "BLOCK", 3)
    items = spark.createDataFrame([(i, f"alpha beta gamma delta{i}") for i in range(9)], "item_id bigint, text string")
    table = docs(spark, [(i, f"alpha beta gamma delta{i} tail{i}") for i in range(40)])
    terms = spark.createDataFrame([("alpha", 1), ("beta", 0), ("gamma", 1), ("delta1", 1), ("delta2", 1)], "term string, anchor int")
    plan = decontam.postings(table, terms, "text", "doc_id", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    assert {r.n_hit for r in decontam.contamination(table, items).collect()} == {4, 0}
