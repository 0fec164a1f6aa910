"""Source divergence against exact sums over plain dictionaries, and its SQL."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from helpers import lower
from oracle import connect, same

from sessionlake.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    docs = [(la or "", so or "", TERM.findall(lower(t))) for la, so, t in rows]
    out = set()
    for lang in {la for la, _, _ in docs}:
        mine = [(so, w) for la, so, w in docs if la == lang]
        held = Counter(t for _, w in mine for t in set(w))
        kept = {t for t, n in held.items() if n >= min_docs}
        count = {so: Counter() for so, _ in mine}
        for so, w in mine:
            count[so].update(t for t in w if t in kept)

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}

        p, q = {so: shares(c) for so, c in count.items()}, shares(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for so in count:
            pairs = [(o, sum(f(p[so][t], p[o][t]) for t in kept)) for o in count if o != so]
            terms = [(t, f(p[so][t], q[t])) for t in kept if count[so][t] and p[so][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda z: (-z[1], z[0].encode()))[:most]
                out |= {(lang, so, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)}
    return out


def frame(spark, rows, partitions=3):
    full = [(la, so, t, "x", 1, [2], 3, 4) for la, so, t in rows]
    return spark.createDataFrame(full, "lang string, source string, text string, term string, n bigint, counts array<int>, at int, width int").repartition(partitions)


def found(df):
    rows = df.collect()
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


ROWS = (
    [("en", "a", "the cat sat É é Z"), ("en", "b", "the dog sat"), ("en", "b", "THE end"), ("en", None, None), ("en", "c", "123 ... _"), ("en", "a", "the cat sat É é Z")]
    + [(None, "a", "the"), (None, "", ""), ("fr", "x", "été"), ("fr", "x", "été"), ("fr", "𝒳", "ﬁn été"), ("fr", "", "ﬁn"), ("de", "solo", "ein ein ein")]
)


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_sums(spark, min_docs):
    assert found(divergence.audit(frame(spark, ROWS), min_docs=min_docs, top=2)) == brute(ROWS, min_docs, 2)


def test_ties_long_texts_and_one_hot_source(spark):
    rows = [("en", "hot", f"w{'abcdefghij'[k % 10]} common")  for k in range(200)] + [("en", f"s{k}", "common other") for k in range(12)] + [("en", "long", "very " * 300_000 + "long")]
    assert found(divergence.audit(frame(spark, rows), min_docs=2, top=3)) == brute(rows, 2, 3)


def test_empty(spark):
    assert found(divergence.audit(frame(spark, []))) == set()


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 4 * 10**15 + 1, 9 * 10**15, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/sf{sf}"
    same(queries.op12_source_divergence(spark, path), connect(path), queries.OP12_SQL)
