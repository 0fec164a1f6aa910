"""Toxicity: planted sentences are found from document labels, scores are the model's noisy-or, held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs, empty

from sessionlake.llm import queries, toxicity

NICE = "the quick brown fox jumps over a lazy dog while rivers run slow and birds sing near old stone houses".split()
RUDE = ["grumble", "snarlish", "vilefoo"]


def corpus(n, seed=3):
    """(rows, labels, planted): every third document holds rude words in one sentence only, some of them in long texts."""
    rng, rows, labels, planted = random.Random(seed), [], [], {}
    for k in range(n):
        parts = [" ".join(rng.choices(NICE, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        if k % 3 == 0:
            at = rng.randrange(len(parts))
            parts[at] = f"you {rng.choice(RUDE).upper()} {rng.choice(RUDE)} " + parts[at]
            planted[k] = (sum(len(p) + 2 for p in parts[:at]), parts[at])
        rows.append((k, ". ".join(parts)))
        labels.append((k, int(k % 3 == 0)))
    return rows, labels, planted


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_sentences_are_located(spark):
    rows, labels, planted = corpus(400)
    found = {r["doc_id"]: r for r in toxicity.detect(docs(spark, rows), labelled(spark, labels)).collect()}
    assert len(found) == len(rows)
    assert [k for k, r in found.items() if r["predicted"] != int(k % 3 == 0)] == []
    for k, text in rows:
        r = found[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        told = [text[s["start"] : s["end"]].strip() for s in r["offending"]]
        assert told == ([planted[k][1]] if k in planted else [])
        assert not told or r["offending"][0]["start"] in (planted[k][0], planted[k][0] - 1)


def test_labels_of_held_out_documents_are_not_read(spark):
    rows, labels, _ = corpus(200)
    lied = [(k, y if zlib.crc32(str(k).encode()) % 4 != 2 else 1 - y) for k, y in labels]
    ask = lambda la: sorted(tuple(r)[:4] for r in toxicity.detect(docs(spark, rows, 1), labelled(spark, la)).collect())
    assert ask(labels) == ask(lied)


def plain_score(model, text):
    spared = 1 - 1 / (1 + math.exp(-model.leak))
    for s in re.split(r"[.!?\n]", text or ""):
        words = re.findall(r"[^\W\d_]+", s.lower())
        if words:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w] + ["^" + w[:k] for k in range(3, 8) if k < len(w)])
            spared *= 1 - 1 / (1 + math.exp(-z))
    return 1 - spared


def test_scores_are_the_noisy_or(spark):
    model = toxicity.ToxicModel({"grumble": 3.0, "^vil": 2.5, "the": -0.5}, -4.0, -3.0)
    texts = [None, "", "...", "Grumble! the vile. villa grumble\nthe the", "é" * 5000 + " grumble", "the fox. " * 20_000]
    some = docs(spark, list(enumerate(texts)))
    for r in toxicity.score(some, model, "text", [some["doc_id"]]).collect():
        assert r["score"] == pytest.approx(plain_score(model, texts[r["row"]["doc_id"]]), abs=1e-9)


def test_spread_and_choice(spark):
    rows = [(1, "bad Bad day", 1), (2, "bad luck", 1), (3, "good day", 0), (4, None, 0), (5, "badly", 0)]
    counts = toxicity._spread(spark.createDataFrame(rows, "id int, text string, y int").repartition(3))
    got = {r["feature"]: (r["pos"], r["neg"]) for r in counts.collect()}
    assert got[None] == (2, 3) and got["bad"] == (2, 0) and got["^bad"] == (0, 1) and got["day"] == (1, 1) and got["badly"] == (0, 1)
    names, n, m = toxicity.choose(counts, ratio=1.0, least=2)
    g2 = 2 * (2 * math.log(2 * 5 / (2 * 2)) + 3 * math.log(3 * 5 / (3 * 3)))
    assert (names, n, m) == (["bad"], 2, 3) and g2 > 1


def test_fit_follows_the_gradient(spark):
    """At the fitted weights no small step of any one parameter lowers the loss by much."""
    rows, labels, _ = corpus(150)
    some = docs(spark, rows, 1).join(labelled(spark, labels), "doc_id").withColumnRenamed("toxic", "y")
    names = [*RUDE, "fox", "the"]
    model = toxicity.fit(toxicity._bags(some, names), names, 50, 100)

    def loss(m):
        p = np.clip([plain_score(m, t) for _, t in rows], 1e-12, 1 - 1e-12)
        y = np.array([y for _, y in labels])
        return -(np.log(p[y == 1]).sum() + np.log(1 - p[y == 0]).sum()) + 0.025 * sum(w * w for w in m.weights.values())

    at = loss(model)
    assert at < 5
    for f in names:
        for step in (-0.05, 0.05):
            assert loss(toxicity.ToxicModel(model.weights | {f: model.weights[f] + step}, model.bias, model.leak)) > at - 0.02


def test_awkward_tables(spark):
    none = labelled(spark, [])
    assert toxicity.detect(empty(spark), none).collect() == []
    rows = [(None, "grumble"), (1, None), (1, "grumble"), (1, "grumble"), (2, "..."), (3, "x" * 300_000)]
    for la in (none, labelled(spark, [(1, 1), (None, 1), (2, None)]), labelled(spark, [(1, 0), (1, 1), (3, 0)])):
        got = toxicity.detect(docs(spark, rows), la).collect()
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "2", "3", "None"]
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_held_out_accuracy(spark):
    """Of held-out documents: nearly all that are toxic and hold any known insult, hardly any that aren't."""
    path = "/root/testdata/sf0.1"
    found = queries.op11_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    print(n)
    assert n[(1, 1)] / (n[(1, 1)] + n[(1, 0)]) >= 0.9
    assert n.get((0, 1), 0) / (n[(0, 0)] + n.get((0, 1), 0)) <= 0.02
