from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from helpers import docs, empty
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import resemblance

SF = "/root/testdata/sf0.001"


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def changed(words, *places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_shingles():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdE") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, " \n", "a b c d", "A b\nC d"]
    for a, b in combinations(texts, 2):
        x, y = resemblance.shingles(a and a.encode()), resemblance.shingles(b and b.encode())
        s, t = brute(a), brute(b)
        assert (len(x), len(set(x.tolist()) & set(y.tolist()))) == (len(s), len(s & t))
        assert resemblance.alike(x, y) == (len(s & t) >= 0.8 * len(s | t))


def test_pairs_at_the_threshold(spark):
    """One changed word of sixty leaves 51 of 61 shingles, two leave 46 of 66."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, changed(words, 30).upper()), (3, changed(words, 10, 40)), (4, None), (5, " \n")]
    out = corpus_pipeline.near_dedup(spark, docs(spark, rows), SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert resemblance.classes(empty(spark)).count() == 0


@pytest.mark.parametrize(("heads", "chunk"), [(3, 1024), (0, 7)])
def test_group_of_near_copies(spark, monkeypatch, heads, chunk):
    """Copies of one text, some pairs of them below the threshold, against all pairs, also of lists in chunks."""
    monkeypatch.setattr(resemblance, "HEADS", heads)
    monkeypatch.setattr(resemblance, "CHUNK", chunk)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, changed(words, *rng.sample(range(80), rng.randint(0, 3)))) for i in range(60)]
    sets, parent = {d: brute(t) for d, t in rows}, {d: d for d, _ in rows}
    for _ in rows:
        for a, b in combinations(sets, 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[a] = parent[b] = min(parent[a], parent[b])
    out = corpus_pipeline.near_dedup(spark, docs(spark, rows), SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(parent.values()))


def test_prefixes():
    """Sets that are alike share as many shingles of their prefixes as the sieve asks for."""
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 60)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randint(0, n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 3))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if resemblance.alike(x, y) and len(x):
            both = np.intersect1d(resemblance.sieve_prefix(x, 0.8), resemblance.sieve_prefix(y, 0.8))
            assert all(len(both) >= resemblance.extra(resemblance.least_shared(len(s), 0.8)) for s in (x, y))


def test_tables(spark):
    """No two kept documents of the test table are alike, and every one that went is linked."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: brute(r.text) for r in table.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, SF).select(F.col("doc_id")).collect()}
    alike = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not [p for p in alike if kept.issuperset(p)]
    assert set(sets) - kept <= {d for p in alike for d in p}


def test_rows_are_the_key(spark):
    """Null and repeated ids lose only rows whose texts are in a component with one that stays."""
    words = [f"w{i}" for i in range(60)]
    copy, near = " ".join(words), changed(words, 30)
    unique = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    gone = [(None, near), (7, near), (7, copy), (2, copy), (None, unique[1]), (9, unique[4])]
    stays = [(1, copy), (None, unique[0]), (None, unique[1]), (7, unique[2]), (8, unique[3]), (8, unique[4]), (None, unique[5])]
    out = corpus_pipeline.near_dedup(spark, docs(spark, gone + stays), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(stays, key=repr)
    out = corpus_pipeline.near_dedup(spark, docs(spark, [(None, near), (None, copy), (None, copy)]), SF)
    assert [(r.doc_id, r.text) for r in out.collect()] == [(None, min(near, copy))]
