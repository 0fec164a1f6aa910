from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import docs, empty
from oracle import connect, same
from pyspark.sql import functions as F

from sessionlake.llm import queries, suffix, superkmer, windows
from sessionlake.llm.common import row_key

SF = "/root/testdata/sf0.001"


def test_suffix_array():
    rng = random.Random(8)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 4])
        t = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        assert suffix.suffix_array(np.array(t, np.int32)) == sorted(range(len(t)), key=lambda i: t[i:])


def text_rows(seed):
    rng = random.Random(seed)
    some = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    blocks = [some(rng.choice([50, 150, 199, 200, 201, 230, 600]), al) for al in ("ab", "abcdefgh ", "é xyz", "a") for _ in range(8)]
    rows = [(i, "".join(rng.choice(blocks) if rng.random() < 0.6 else some(rng.randint(0, 250), "abcd efgh") for _ in range(rng.randint(0, 5)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 400), (3, rows[3][1]), (4, "x" + rows[5][1]), (None, rows[6][1]), (None, "abc" * 200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot", "bits"), [(1, None, 27), (2, 2, 20), (3, 6, 4)])
def test_bytes(spark, monkeypatch, seed, hot, bits):
    if hot:
        monkeypatch.setattr(windows, "HOT", hot)
    rows = text_rows(seed)
    rows += [rows[0], (None, "abc" * 200), (900, "short"), (900, "short")]
    count = Counter(b[p : p + 200] for b in ((t or "").encode() for _, t in rows) for p in range(len(b) - 199))
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        want[(d, len(b), int(gone.sum()), tuple(map(tuple, edges.tolist())), bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((s.lo, s.hi) for s in r.spans), bytes(r.kept)) for r in suffix.dedup(docs(spark, rows), sieve_bits=bits).collect())
    assert got == want


@pytest.mark.parametrize(("seed", "hot", "bits"), [(1, None, 27), (2, 2, 20), (3, 6, 4)])
def test_words(spark, monkeypatch, seed, hot, bits):
    if hot:
        monkeypatch.setattr(windows, "HOT", hot)
    rng = random.Random(seed)
    blocks = [[rng.choice(["a", "b", "cc", f"d{rng.randint(0, 30)}"]) for _ in range(rng.choice([5, 19, 20, 21, 30, 60]))] for _ in range(12)] + [["a"] * 50, ["a", "b"] * 30]
    one = lambda: rng.choice(blocks) if rng.random() < 0.6 else [str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 30))]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in one())) for i in range(80)]
    rows += [(200, None), (201, " \n"), (7, rows[7][1]), (8, "q " + rows[9][1]), (None, rows[6][1])]
    rng.shuffle(rows)
    frame = docs(spark, rows)
    rk = {(r.doc_id, r.text): r.rk for r in frame.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("rk")).collect()}
    seen, kept = set(), {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, rk[x])):
        w = (t or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            if window in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(window)
        kept[(d, t)] = (d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in superkmer.dedup(frame, sieve_bits=bits).collect())
    assert got == Counter(kept[r] for r in rows)


def test_empty(spark):
    assert superkmer.dedup(empty(spark)).count() == 0
    assert suffix.dedup(empty(spark)).count() == 0


def keys_by_window(runs):
    return {base + a + i: int(k) for base, _, r in runs for a, n, k in zip(r.start.tolist(), r.count.tolist(), r.key.tolist(), strict=True) for i in range(n)}


def test_long_texts_in_stretches(monkeypatch):
    """A window's minimiser does not depend on where a long text is cut into stretches."""
    rng = random.Random(12)
    text = "".join(rng.choice(["ab", "c d", "e\n", "a" * 9]) for _ in range(2000)).encode()
    whole = keys_by_window(suffix.stretches(text))
    assert sorted(whole) == list(range(len(text) - 199))
    monkeypatch.setattr(suffix, "STRETCH", 317)
    assert keys_by_window(suffix.stretches(text)) == whole
    whole = keys_by_window(superkmer.stretches(text))
    assert sorted(whole) == list(range(len(text.split()) - 19))
    chunks = superkmer.word_chunks
    monkeypatch.setattr(superkmer, "word_chunks", lambda t: chunks(t, 97))
    assert keys_by_window(superkmer.stretches(text)) == whole


def test_very_long_text(spark):
    rng = random.Random(13)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, "x " + long), (3, long[1000:3000])]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in superkmer.dedup(docs(spark, rows)).collect()}
    assert got[1] == (200_000, 0) and got[2] == (200_001, 200_000) and got[3][1] >= got[3][0] - 2
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.dedup(docs(spark, rows)).collect()}
    assert got[1] == (len(long), len(long)) and got[2] == (len(long) + 2, len(long)) and got[3] == (2000, 2000)


@pytest.mark.parametrize("n", [1000, 4000])
def test_near_copies_have_few_spans(spark, monkeypatch, n):
    """Spans grow with the copies, not with the windows of each, on either side of HOT."""
    made = []
    joined = windows.with_spans
    monkeypatch.setattr(suffix, "with_spans", lambda docs, found: (made.append(found.count()), joined(docs, found))[1])
    rng = random.Random(14)
    text = "".join(rng.choice("abcdefgh ") for _ in range(820))
    places = [rng.randrange(820) for _ in range(n)]
    rows = [(i, text[:p] + chr(65 + i % 26) + str(i) + text[p + 1 :]) for i, p in enumerate(places)]
    got = {r.doc_id: r.n_removed for r in suffix.dedup(docs(spark, rows)).collect()}
    assert made[0] < 10 * n
    count = Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert got[d] == gone.sum()


@pytest.mark.parametrize("name", ["op6_superkmer_dedup", "op8_suffix_dedup"])
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op6_superkmer_dedup", "op8_suffix_dedup"])
def test_oracle_on_repeated_rows(spark, tmp_path, name):
    """Query and SQL agree where rows repeat."""
    rows = [(d, t) for d, t in text_rows(5) if d is not None and d != 3]
    spark.createDataFrame([*rows, *rows[:9]], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE_SQL[name])
