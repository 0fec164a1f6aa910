"""Short-term entries that repeat long-term ones, by overlap of keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.functions import text as x
from sessionlake.operators.daily import mark
from sessionlake.scratch import Scratch


def encoded(side: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """(key, n, ids): each entry's number of words, and of those in words (w, no, count) the numbers, rarest first."""
    rows = side.select(key, F.size("words").alias(f"n_{key}"), F.explode("words").alias("w")).join(words, "w")
    order = F.array_sort(F.collect_list(F.struct("count", "no")))
    return rows.groupBy(key, f"n_{key}").agg(F.transform(order, lambda z: z["no"]).alias(f"ids_{key}"))


def candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs that share a word of the smaller set's prefix, from encoded sides.

    Of the smaller set's n words, taken rarest first, one of the first
    n - ceil(threshold * n) + 1 is in the other if they match. Words that only one side has come
    first and count, but are not joined. So prefixes of either side are joined with whole sets of the
    other side that are no smaller; a word that most sets have is in the prefix of tiny sets only.
    """

    def posted(side: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        ids, n = F.col(f"ids_{key}"), F.col(f"n_{key}")
        least = F.ceil(n * F.lit(threshold) - 1e-9).cast("int")
        first = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - least + 1, F.lit(0)))
        return tuple(side.select(key, n, F.explode(c).alias("no")) for c in (ids, first))

    (all_a, first_a), (all_b, first_b) = posted(a, "a"), posted(b, "b")
    small_a = first_a.join(all_b, "no").where("n_a <= n_b").select("a", "b")
    small_b = first_b.join(all_a, "no").where("n_b < n_a").select("a", "b")
    return small_a.unionByName(small_b).distinct()


def shared_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """(w, no, count): the words that both sides have, numbered, with the number of entries that have them."""
    counts = [side.select(F.explode("words").alias("w")).groupBy("w").count() for side in (a, b)]
    both = counts[0].join(counts[1].withColumnRenamed("count", "other"), "w")
    return both.select("w", (F.col("count") + F.col("other")).alias("count"), F.monotonically_increasing_id().alias("no"))


def matches(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b): ids of entries whose overlap coefficient reaches the threshold.

    left, right: (id, words), words distinct. Words that both sides have are numbered, an exact
    prefix filter gives candidates, and those are verified on the numbers. What is needed several
    times is written to the shared folder first, as words are dear to extract.
    """
    scratch = Scratch(left.sparkSession)
    a, b = (scratch.save(side.select(F.col("id").alias(key), "words"), name) for side, key, name in ((left, "a", "left"), (right, "b", "right")))
    words = scratch.save(shared_words(a, b), "words")
    a, b = scratch.save(encoded(a, "a", words), "left"), scratch.save(encoded(b, "b", words), "right")
    pairs = candidates(a, b, threshold).join(a, "a").join(b, "b")
    overlap = F.size(F.array_intersect("ids_a", "ids_b")) / F.least("n_a", "n_b")
    return pairs.where(overlap >= threshold).select("a", "b")


def matched(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id): the word sets of left that match any of right's; both (id, words), the id being the sorted words.

    A set that both sides have needs no search, and leaves it before candidates are made.
    """
    left, right = left.where("id <> ''"), right.where("id <> ''")
    same = left.join(right.select("id"), "id", "left_semi").select("id")
    rest = left.join(right.select("id"), "id", "left_anti")
    return same.unionByName(matches(rest, right, threshold).select(F.col("a").alias("id")).distinct())


def word_sets(words: DataFrame) -> DataFrame:
    """(id, words): each distinct word set once; its id is the sorted words."""
    return words.select(set_id().alias("id"), "words").groupBy("id").agg(F.first("words").alias("words"))


def set_id() -> Column:
    return F.array_join(F.array_sort("words"), " ")


def mark_routed(daily: DataFrame, notes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Daily lines (day, line_no, line, section) with line marked where it repeats a note, and marked.

    Only tagged, not yet routed entries of Learnings and Lessons count; notes: (line), of
    which the dated entries count, whatever their scope.
    """
    topic = F.regexp_replace("section", r"(?U)^[# ]+|[# ]+$", "")
    entry = topic.isin("Learnings", "Lessons") & F.col("line").rlike(r"(?U)^\s*-\s*\[") & ~F.col("line").rlike(r"(?U)^\s*-\s*\[routed")
    scratch = Scratch(daily.sparkSession)
    left = scratch.save(daily.where(entry).select("day", "line_no", x.keywords("line").alias("words")).withColumn("id", set_id()), "entries")
    right = notes.where(F.col("line").rlike(r"(?U)^\s*-\s*\(")).select("line").distinct().select(x.keywords("line").alias("words"))
    found = matched(word_sets(left), scratch.save(word_sets(right), "notes"), threshold)
    found = left.join(found, "id").select("day", "line_no").distinct().withColumn("marked", F.lit(True))
    rows = daily.join(found, ["day", "line_no"], "left").fillna(False, ["marked"])
    return rows.withColumn("line", F.when(F.col("marked"), mark(F.col("line"))).otherwise(F.col("line")))
