"""Quality rules: a learned decision list over text statistics, applied as one CASE.

Statistics are Spark expressions over whole texts. Learning: the labelled statistics are
cut at thresholds (midway between quantiles of either class) and counted by cell in one aggregation;
the cells, at most (thresholds + 1) ** features of them for a grow and a prune part, are
all that reaches the driver, whatever the size of the corpus. Sequential covering then
grows a conjunction of thresholds by information gain, prunes it on the held-out cells,
accepts it if it is precise there, removes what it covers and goes on. The rules become
an ordered conditional expression: the first that holds rejects, else the text is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import WORD_SPACE, Scratch, words_of

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_echo_words", "n_lines")
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "echo_share": ("n_echo_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}
#: Quantiles whose midpoints are the candidate thresholds: of good texts, and of bad ones.
GOOD_AT, BAD_AT = (0.001, 0.5, 0.99, 0.999), (0.02, 0.1, 0.25, 0.5, 1.0)
MAX_THRESHOLDS = len(GOOD_AT) + len(BAD_AT) - 1


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = share(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]
#: Number of a feature, whether its value is at least the threshold, and the threshold's number.
Option = tuple[int, bool, int]


def share(feature: str) -> Column:
    """A feature from the statistics columns; 0 where its denominator is 0."""
    top, bottom = FEATURES[feature]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def with_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``doc`` (a struct of the kept columns) and STATS, all bigint, for every row.

    Null text counts as empty: every statistic is 0. Built-in functions only, no shuffle.
    A window's hash stands for its words; equal hashes are taken as equal within one text.
    """
    t = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(text).alias("t"))
    step = step.select("doc", "t", F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"))
    n = F.size("h")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    count = lambda cls: (F.length(t) - F.length(F.regexp_replace(t, cls, ""))).cast("bigint")
    step = step.select(
        "doc", n.cast("bigint").alias("n_words"), F.length(F.regexp_replace(t, f"[{WORD_SPACE}]+", "")).cast("bigint").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        count("[A-Z]+").alias("n_upper"), F.size(F.filter("h", lambda x, i: x == F.get("h", i - 1))).cast("bigint").alias("n_echo_words"), F.size("lines").cast("bigint").alias("n_lines"), windows.alias("w"),
    )
    again = F.size(F.array_distinct("w")) < F.size("w")
    order = F.when(again, F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    step = step.withColumn("o", order).drop("w")
    twice = lambda e, i: F.when((F.get("o", i - 1)["x"] == e["x"]) | (F.get("o", i + 1)["x"] == e["x"]), e["i"]).otherwise(F.lit(-1))
    step = step.withColumn("p", F.sort_array(F.filter(F.transform("o", twice), lambda i: i >= 0))).drop("o")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["c"] + F.least(F.lit(WINDOW), i - a["last"])).alias("c"), i.alias("last")), lambda a: a["c"])
    return step.withColumn("n_repeat_words", covered.cast("bigint")).select("doc", *STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: midway between neighbouring quantiles of the good and the bad."""
    made = {}
    exprs = []
    for f in FEATURES:
        for good, at in ((1, GOOD_AT), (0, BAD_AT)):
            exprs.append(F.percentile_approx(F.when(F.col("good") == good, share(f)), list(at), 10000).alias(f"{f}_{good}"))
    row = labelled.agg(*exprs).first()
    for f in FEATURES:
        values = sorted({float(v) for good in (1, 0) for v in (row[f"{f}_{good}"] or [])})
        made[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return made


@dataclass
class Cells:
    """Counts of labelled rows by cell: bins (one row for each cell, one column for each feature), part, bad, good."""

    bins: np.ndarray
    part: np.ndarray
    bad: np.ndarray
    good: np.ndarray

    def only(self, which: np.ndarray) -> Cells:
        return Cells(self.bins[which], self.part[which], self.bad[which], self.good[which])

    def holds(self, rule: list[Option]) -> np.ndarray:
        out = np.ones(len(self.part), bool)
        for k, up, b in rule:
            out &= (self.bins[:, k] >= b) == up
        return out

    def totals(self) -> tuple[int, int]:
        return int(self.bad.sum()), int(self.good.sum())

    def by_option(self, cuts: list[int]) -> dict[Option, tuple[int, int]]:
        """(bad, good) of the cells where each single condition holds; cuts: thresholds by feature."""
        out, (bad, good) = {}, self.totals()
        for k, n in enumerate(cuts):
            b, g = (np.bincount(self.bins[:, k], x, n + 1)[::-1].cumsum()[::-1] for x in (self.bad, self.good))
            for i in range(1, n + 1):
                out[k, True, i] = (int(b[i]), int(g[i]))
                out[k, False, i] = (bad - int(b[i]), good - int(g[i]))
        return out


def cells(labelled: DataFrame, cuts: dict[str, list[float]]) -> Cells:
    """Counts of the labelled rows by cell; part 1 is for pruning."""
    bins = [reduce(lambda a, b: a + b, [(share(f) >= F.lit(c)).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in FEATURES]
    part = F.coalesce((F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 2).cast("int"), F.lit(0)).alias("part")
    rows = labelled.select(*bins, part, "good").groupBy(*FEATURES, "part").agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")).toArrow()
    order = np.lexsort([rows.column(c).to_numpy() for c in ("part", *reversed(FEATURES))])
    column = lambda c: rows.column(c).to_numpy().astype(np.int64)[order]
    return Cells(np.stack([column(f) for f in FEATURES], 1), column("part"), column("bad"), column("good"))


def cover(table: Cells, cuts: dict[str, list[float]], max_rules: int = 12, max_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Sequential covering over the cells; see the module.

    A list has at most max_rules rules of at most max_conditions conditions, so that it can be
    read; a rule covers at least ``least`` bad rows, with the precision on the held-out
    cells and on all. Of options with equal gain the first counts.
    """
    names, left, rules = list(FEATURES), table, []
    sizes = [len(cuts[f]) for f in names]
    while len(rules) < max_rules:
        rule, rows = [], left.only(left.part == 0)
        bad, good = rows.totals()
        while good and bad and len(rule) < max_conditions:
            gain = lambda b, g: b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good))) if b else 0.0  # noqa: B023, E731
            options = rows.by_option(sizes)
            best = max(options, key=lambda o: gain(*options[o]))
            if gain(*options[best]) <= 1e-9:
                break
            rule.append(best)
            rows = rows.only(rows.holds([best]))
            bad, good = rows.totals()
        if not rule:
            break
        worth = []
        for n in range(1, len(rule) + 1):
            b, g = left.only((left.part == 1) & left.holds(rule[:n])).totals()
            worth.append(((b - g) / (b + g) if b + g else -1.0, -n))
        rule = rule[: -max(worth)[1]]
        covered = left.holds(rule)
        held, (b, g) = left.only(covered & (left.part == 1)).totals(), left.only(covered).totals()
        if b < least or held[0] < precision * sum(held) or b < precision * (b + g):
            break
        rules.append(tuple(Condition(names[k], up, cuts[names[k]][n - 1]) for k, up, n in rule))
        left = left.only(~covered)
    return rules


def learn(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> list[Rule]:
    """Rules for bad texts from labelled rows (quality 1 good, 0 bad; others are ignored)."""
    marks = labels.select(F.col(doc_id).alias("id"), F.col(quality).cast("int").alias("good")).where("good in (0, 1) and id is not null")
    labelled = stats.select(F.col(f"doc.{doc_id}").alias("id"), *STATS).where("not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)").join(marks, "id")
    cuts = thresholds(labelled)
    return cover(cells(labelled, cuts), cuts)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: true keeps."""
    out = None
    for rule in rules:
        cond = reduce(lambda a, b: a & b, [c.column() for c in rule])
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``doc`` (struct of the kept columns, default all), STATS, base_failed and kept.

    Every row is judged, repeated ones and those with null ids included, by its whole text,
    however long; a null or empty text fails the base rules. Of labels, rows with a null id or
    quality are ignored, and a text with several labels counts for each. Without usable labels, or with labels of one class, no rule
    is learned and the base rules decide. The statistics are written once to the shared
    folder, then learned from and judged.
    """
    keep = tuple(docs.columns) if keep is None else keep
    stats = Scratch(docs.sparkSession).save(with_stats(docs, text, keep if doc_id in keep else (doc_id, *keep)), "stats")
    rules = learn(stats, labels, doc_id)
    return stats.select("doc", *STATS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
