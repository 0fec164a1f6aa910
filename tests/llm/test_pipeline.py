from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from test_decontam import tokens
from test_pii import brute as spans_of
from test_resemblance import brute as shingles
from test_rules import brute as stats_of
from test_simhash import brute as print_of
from test_simhash import close
from tokenizers import Tokenizer

import corpus_pipeline
from sessionlake.llm import pii, queries

SF = "/root/testdata/sf0.001"


def least_of_groups(texts):
    """The least id of every group of texts that link: fingerprints at two bits or fewer, or 0.8 of five-word shingles."""
    prints, sets = {d: print_of(t) for d, t in texts.items()}, {d: shingles(t) for d, t in texts.items()}
    roots, parent = close(set(prints.values())), {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        if roots[prints[a]] == roots[prints[b]] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {root(d) for d in texts}


def test_stages(spark, tmp_path):
    """Each stage against a brute-force version, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = kept["quality_rules"]
    for d, t in before.items():
        n, _, _, _, repeat = stats_of(t)
        if n < 20 or 100 * repeat > 30 * n:
            assert d not in first
        elif label.get(d) == 1:
            assert d in first
    assert all(before[d] == t for d, t in first.items())
    assert set(kept["simhash_near_dedup"]) == least_of_groups(first)
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = tokens(r.text)
        phrases |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    bad = {d for d, t in kept["simhash_near_dedup"].items() for n in {len(p) for p in phrases} if any(tuple(tokens(t)[i : i + n]) in phrases for i in range(len(tokens(t)) - n + 1))}
    assert set(kept["benchmark_decontamination"]) == set(kept["simhash_near_dedup"]) - bad
    for d, t in kept["pii"].items():
        source = kept["benchmark_decontamination"][d]
        assert not spans_of(t)
        if not spans_of(source):
            assert t == source
        else:
            assert sum(t.count(f"<{k}>") for k in pii.KINDS) >= 1
    assert set(kept["pii"]) == set(kept["benchmark_decontamination"])
    plain = Tokenizer.from_file(queries.tokenizer_files()["tokenizer"])
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in pieces.items()} == {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in kept["pii"].items()}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_one_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(2, text), (2, text), (1, text), (1, text + " "), (5, "something else entirely is here"), (5, "something else entirely is here"), (None, "all alone is this one row"), (None, "all alone is this one row")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, text), (5, "something else entirely is here"), (None, "all alone is this one row")], key=repr)


CLASHING = "d bigint, r string, n bigint, root bigint, doc string, rk string, other_d bigint, node bigint, spans string, masked string, kept boolean, `a.b` int, key string, h double, item_ids string"


def clashing(spark, rows):
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, "r", 2, 3, "doc", "rk", 4, 5, "s", "m", True, 6, "k", 0.5, "i") for d, t in rows], schema).repartition(3)


def test_awkward_rows(spark, monkeypatch):
    """Nulls, empty and very long texts, ties, repeats, clashing names and empty tables in every stage."""
    first = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    words = [f"w{i}" for i in range(80)]
    plain, other = " ".join(words), " ".join(f"v{i}" for i in range(80))
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, plain), (1, plain), (None, plain), (None, None), (None, None), (2, None), (3, ""), (4, " \n"), (5, long), (6, other), (6, first + " " + other), (None, other + " x"), (7, "mail a.b@c.de now")]
    table = clashing(spark, rows)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)
    key = lambda rows: sorted(rows, key=repr)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none, out[name] = stage(spark, table.limit(0), SF), stage(spark, table, SF)
        assert none.count() == 0 and none.columns == table.columns and out[name].schema == table.schema
    assert pairs(out["quality_rules"]) == key([r for r in rows if r[1] and len(r[1].split()) >= 20])
    assert pairs(out["simhash_near_dedup"]) == key([(1, plain), (2, None), (5, long), (6, other), (6, first + " " + other), (7, "mail a.b@c.de now")])
    assert pairs(out["benchmark_decontamination"]) == key([r for r in rows if r != (6, first + " " + other)])
    assert pairs(out["pii"]) == key([(d, "mail <email> now" if d == 7 else t) for d, t in rows])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out["pii"].collect())
    packed = corpus_pipeline.pack(spark, table, SF).collect()
    assert sorted((r.doc_id, r.length) for r in packed if r.doc_id in (2, 3)) == [(2, 1), (3, 1)]
    assert sum(r.length for r in packed if r.doc_id == 1) == 2 * next(r.doc_tokens for r in packed if r.doc_id == 1)
    assert corpus_pipeline.pack(spark, table.limit(0), SF).count() == 0
