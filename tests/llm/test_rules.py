from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from helpers import docs, empty, words

from sessionlake.llm import queries, rules


def brute(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered, lines, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "bé", "c", " ", " ", "\n", "\t", "#|", " ", "!"]) for _ in range(rng.randint(0, 200)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "x " * 500), (93, "a b c d e f g h " * 3), (None, "p q"), (3, rows[3][1]), (94, "é\r\n\r\né\r\n")]
    got = rules.with_stats(docs(spark, rows)).collect()
    assert Counter((r.doc.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((d, *brute(t)) for d, t in rows)


def test_learning(spark):
    rng = random.Random(4)
    good = lambda: " ".join("word%d" % rng.randint(0, 999) for _ in range(rng.randint(30, 60)))
    bad = lambda k: " | ".join("word%d" % rng.randint(0, 999) for _ in range(40)) if k % 2 else good().upper()
    rows = [(i, bad(i // 4) if i % 4 == 0 else good()) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (99999, 0, 0)], "doc_id bigint, quality int, toxic int")
    judged = rules.judge(docs(spark, rows), labels, keep=("doc_id", "kept"))
    got = {r.doc.doc_id: r.kept for r in judged.collect()}
    assert got == {i: i % 4 != 0 for i in range(800)}
    none = rules.judge(docs(spark, rows[:30]), labels.limit(0)).collect()
    assert all(r.kept for r in none)
    assert rules.judge(empty(spark), labels).count() == 0


def kind_of_text(rng, kind):
    """Texts of which symbols with long words, and short words without symbols, are good."""
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    long = kind in ("plain", "long-symbols", "upper", "echo")
    words = [word(rng.randint(6, 9) if long else rng.randint(2, 3)) for _ in range(rng.randint(40, 80))]
    if "symbols" in kind:
        words = [f"{w} |" if i % 3 == 0 else w for i, w in enumerate(words)]
    if kind == "echo":
        words = [x for w in words for x in ([w, w] if rng.random() < 0.5 else [w])]
    return " ".join(words).upper() if kind == "upper" else " ".join(words)


def test_several_rules(spark):
    """Three kinds of bad texts, one of them only told by two conditions together."""
    rng = random.Random(5)
    bad = ("short-symbols", "upper", "echo")
    kinds = [k for k in ("plain", "long-symbols", "short", *bad) for _ in range(150)]
    rows = [(i, kind_of_text(rng, k)) for i, k in enumerate(kinds)]
    labels = spark.createDataFrame([(i, int(k not in bad)) for i, k in enumerate(kinds)], "doc_id bigint, quality int")
    found = rules.learn(rules.with_stats(docs(spark, rows)), labels)
    assert len(found) >= 3 and max(map(len, found)) >= 2
    more = [(i, kind_of_text(rng, k)) for i, k in enumerate(kinds)]
    judged = rules.with_stats(docs(spark, more)).select("doc.doc_id", rules.verdict(found).alias("kept")).collect()
    wrong = [r.doc_id for r in judged if r.kept != (kinds[r.doc_id] not in bad)]
    assert len(wrong) <= 0.02 * len(kinds), (found, Counter(kinds[d] for d in wrong))


def test_cover_by_hand():
    """Options are counted as by a loop over the cells."""
    rng = np.random.default_rng(6)
    table = rules.Cells(rng.integers(0, 4, (200, 6)), rng.integers(0, 2, 200), rng.integers(0, 9, 200), rng.integers(0, 9, 200))
    for (k, up, b), counts in table.by_option([3] * 6).items():
        rows = [i for i in range(200) if (table.bins[i, k] >= b) == up]
        assert counts == (table.bad[rows].sum(), table.good[rows].sum())
    assert rules.cover(table.only(np.zeros(200, bool)), {f: [0.1, 0.2, 0.3] for f in rules.FEATURES}) == []


def test_verdict_is_native(spark):
    found = rules.verdict([(rules.Condition("symbol_share", True, 0.1), rules.Condition("mean_word_chars", False, 3.0)), (rules.Condition("upper_share", True, 0.5),)])
    frame = spark.createDataFrame([(10, 20, 5, 0, 0, 0, 0, 1), (10, 40, 5, 0, 0, 0, 0, 1), (10, 40, 0, 0, 0, 30, 0, 1), (0, 0, 0, 0, 0, 0, 0, 0)], ", ".join(f"{c} bigint" for c in rules.STATS))
    assert [r[0] for r in frame.select(found).collect()] == [False, True, False, True]


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {d: tuple(rows[d][c] for c in rules.STATS[:5]) for d in rows} == {d: brute(t) for d, t in text.items()}
    assert all(not r.kept for r in rows.values() if r.base_failed)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows.values())
