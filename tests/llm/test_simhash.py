from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import docs, empty, lower, words

from sessionlake.llm import queries, simhash
from sessionlake.llm.common import Scratch


def brute(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choice(["a", "Bé", " ", "\n", "c ", "\x0b", " "]) for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == brute(text), repr(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 99)) for _ in range(200_000))
    assert simhash.fingerprint(long.encode()) == brute(long)


def close(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= 2:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {v: root(v) for v in values}


def classes(pairs):
    out = {}
    for v, r in pairs:
        out.setdefault(r, set()).add(v)
    return {frozenset(c) for c in out.values() if len(c) > 1}


def test_groups():
    """Whatever two bytes a pair differs in, it shares a group of every set that it shares, down to six bytes."""
    for differ in combinations(range(8), 2):
        shared, todo = sum(1 << p for p in range(8) if p not in differ), [0]
        while todo:
            mask = todo.pop()
            inside = [g for g in simhash.GROUPS[mask] if g & ~shared == 0]
            assert inside or bin(mask).count("1") >= 6
            todo += inside


def test_filter():
    """The tally is the number of bytes shared; the filter rejects pairs, loses no link, and what it retains is still verified."""
    rng = random.Random(3)
    prints, lists = [], []
    for number, mask in enumerate((0b111, 0b11000, 0b11100000)):
        base, seen = rng.getrandbits(64), set()
        while len(seen) < 60:
            v = base if rng.random() < 0.5 or not seen else rng.choice(sorted(seen))
            for p in rng.sample([p for p in range(8) if not mask >> p & 1], rng.randint(0, 4)):
                v = v & ~(255 << 8 * p) | (rng.getrandbits(8) << 8 * p) if rng.random() < 0.5 else v ^ 1 << 8 * p + rng.randint(0, 7)
            seen.add(v)
        prints += sorted(seen)
        lists += [(number, mask)] * 60
    fps, (number, mask) = np.array(prints, np.uint64).view(np.int64), np.array(lists, np.int64).T
    a, b, shared = simhash.tally(fps, number, mask)
    got = dict(zip(zip(a.tolist(), b.tolist(), strict=True), shared.tolist(), strict=True))
    want, linked = {}, set()
    for i, j in combinations(range(len(prints)), 2):
        if lists[i][0] == lists[j][0]:
            differ = prints[i] ^ prints[j]
            same = sum(differ >> 8 * p & 255 == 0 for p in range(8))
            if same > bin(lists[i][1]).count("1"):
                want[i, j] = same
            if bin(differ).count("1") <= 2:
                linked.add((i, j))
    assert got == want
    retained = {k for k, n in got.items() if n >= simhash.MIN_SHARED}
    assert linked < retained < set(got) and len(got) > 2 * len(retained)
    a, b = simhash.near(fps, number, mask)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == linked


def test_neighbours_and_portions():
    rng = random.Random(4)
    base = rng.getrandbits(64) & ~0xFF0000FF0000
    prints = [base | (x & 255) << 16 | (x >> 8) << 40 for x in rng.sample(range(1 << 16), 500)]
    mask = 0b11011011
    a, b = simhash.neighbours(mask, np.array(prints, np.uint64).view(np.int64))
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(p) for p in combinations(range(500), 2) if bin(prints[p[0]] ^ prints[p[1]]).count("1") <= 2}
    sizes = np.array([2, 1500, 3, 0, 1024, 1024, 1024])
    cut = list(simhash.portions(sizes))
    assert [k for s in cut for k in range(s.start, s.stop)] == list(range(7)) and len(cut) > 3
    assert list(simhash.portions(sizes[:0])) == []


@pytest.mark.parametrize("long", [1024, 40, 3])
def test_components(spark, monkeypatch, long):
    """Random walks of one to three bits, and a dense list that shares six bytes, with lists parted early or late."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for start in list(prints)[:12]:
        v = start
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << b
            prints.add(v)
    base = rng.getrandbits(64) & ~0xFFFF
    prints |= {base | x for x in rng.sample(range(1 << 16), 300)}
    signed = [int(np.uint64(v).view(np.int64)) for v in prints]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    got = simhash.components(Scratch(spark), simhash.links(frame)).collect()
    want = close(prints)
    assert classes([(int(np.int64(r.node).view(np.uint64)), r.root) for r in got] + [(int(np.int64(r).view(np.uint64)), r) for r in {x.root for x in got}]) == classes(want.items())


def test_documents(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text.upper()), (9, text + "\n"), (7, None), (8, " "), (2, "quite another text with other words in it"), (None, text), (3, text.upper()), (None, "alone alone alone")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7, 2: 2}
    assert sorted((r.component_id or -1) for r in got if r.doc_id is None) == [-1, 3]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_query(spark):
    """The registered query, against fingerprints and links made by hand."""
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    roots, least = close(set(rows.values())), {}
    for d in sorted(rows):
        least.setdefault(roots[rows[d]], d)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, sf).collect())
    assert got == sorted((d, f"{v:016x}", least[roots[v]]) for d, v in rows.items())
