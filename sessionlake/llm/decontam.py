"""Benchmark decontamination by a distributed positional inverted index.

Test phrases are windows of item words. Their terms are counted over the whole corpus; the
rarest two terms of each phrase are its seeds, and the corpus postings (row, position) of
all seed terms are stored, those of a phrase's rarest term with the words around them. A phrase
occurs where its seeds' lists, each moved back by the seed's offset, meet in one start
and the stored words agree; a proximity match has all its words in a few more words than the
phrase has, in any order. Documents are read as tokens to count and to store; only postings
of seed terms are shuffled, never texts. Terms are broadcast in blocks of a fixed size, one
pass over the tokens for each block, however many there are. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import Scratch, ascii_lower, row_key

WINDOW, SEEDS, SLOP = 10, 2, 2
#: Terms or seeds (some MB) that are broadcast at once.
BLOCK = 100_000
#: Stands for the end of a document in the postings; no word is empty.
END = ""


def index_words(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters and digits and all non-ASCII characters."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items, pid, no): distinct windows of the items, with the ids of those that have them.

    pid is the window's digest; no is a number for it, to be saved before it is used.
    """
    words = items.select(F.col(item_id).cast("string").alias("item"), index_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    found = cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("pid", F.sha2(F.array_join("words", " "), 256)).withColumn("no", F.monotonically_increasing_id())


def blocks(side: DataFrame, *key: str) -> list[DataFrame]:
    """side in parts of about BLOCK rows, each marked for broadcast; key tells its rows apart."""
    n = max(1, -(-side.count() // BLOCK))
    return [F.broadcast(side.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) if n > 1 else side) for k in range(n)]


def joined(rows: DataFrame, parts: list[DataFrame], on: str) -> DataFrame:
    """rows joined to each part in turn."""
    return reduce(DataFrame.unionByName, [rows.join(part, on) for part in parts])


def seeds(docs: DataFrame, found: DataFrame, scratch: Scratch, text: str) -> DataFrame:
    """(no, rank, term, off, words): the rarest two terms of each phrase, words with the rarest.

    Counts are over all documents. A phrase with a term that no document has is left out.
    """
    terms = scratch.save(found.select("no", "words", F.posexplode("words").alias("off", "term")), "terms")
    vocabulary = scratch.save(terms.select("term").distinct(), "vocabulary")
    tokens = docs.select(F.explode(index_words(F.col(text))).alias("term"))
    counts = scratch.save(joined(tokens, blocks(vocabulary, "term"), "term").groupBy("term").count(), "counts")
    whole, ranked = Window.partitionBy("no"), Window.partitionBy("no").orderBy("count", "off")
    ranks = terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    ranks = ranks.withColumn("least", F.min("count").over(whole)).withColumn("rank", F.row_number().over(ranked))
    ranks = ranks.where((F.col("least") > 0) & (F.col("rank") <= SEEDS))
    return ranks.select("no", "rank", "term", "off", F.when(F.col("rank") == 1, F.col("words")).alias("words"))


def postings(docs: DataFrame, terms: DataFrame, text: str, doc_id: str, span: int) -> DataFrame:
    """(doc_id, rk, term, pos, ctx, ctx_at): the stored index of terms (term, anchor).

    One posting for each occurrence of a term, and one of END at each row's word count. ctx holds
    the words from ctx_at on, span to either side, where the term is some phrase's rarest.
    """
    tokens = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), index_words(F.col(text)).alias("w"))
    at = F.greatest(F.col("pos") - span, F.lit(0))
    ctx = F.when(F.col("anchor") == 1, F.slice("w", at + 1, F.col("pos") - at + span + 1))
    parts, end = blocks(terms, "term"), F.array(F.lit(END))
    out = []
    for k, part in enumerate(parts):
        words = F.concat("w", end) if k == 0 else F.col("w")
        known = F.broadcast(part.unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(0).alias("anchor")))) if k == 0 else part
        rows = tokens.select("doc_id", "rk", "w", F.posexplode(words).alias("pos", "term")).join(known, "term")
        out.append(rows.select("doc_id", "rk", "term", "pos", ctx.alias("ctx"), at.alias("ctx_at")))
    return reduce(DataFrame.unionByName, out)


def _within(words: Column, ctx: Column, anchor: Column, width: Column) -> Column:
    """Whether some width words of ctx that hold its word number anchor hold all words, as often as they repeat."""
    often = lambda among, w: F.size(F.filter(among, lambda y: y == w))
    holds = lambda s: F.forall(F.array_distinct(words), lambda w: often(F.slice(ctx, s, width), w) >= often(words, w))
    return F.exists(F.sequence(F.greatest(anchor - width + 2, F.lit(1)), anchor + 1), holds)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(directory, found): every row with its word count, and all matches.

    directory: doc_id, rk, n_words. found: doc_id, rk, pid, start, n (words), items, kind;
    kind is "phrase" for exact matches and, where slop is given, "near" for occurrences of a
    phrase's rarest word in some n + slop words that hold all of the phrase's, each as often as
    it is in the phrase, in any order, where the phrase itself is not; start is where it would
    begin. rk tells apart rows that share a doc_id; rows equal in doc_id and text are one
    document, whose matches come as often as its row. Null and wordless texts match nothing;
    texts of any length are searched whole.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.save(phrases(items, item_id, item_text, window), "phrases")
    seed = scratch.save(seeds(docs, known, scratch, text), "seeds")
    terms = scratch.save(seed.groupBy("term").agg(F.max((F.col("rank") == 1).cast("int")).alias("anchor")), "terms")
    store = scratch.save(postings(docs, terms, text, doc_id, window - 1 + (slop or 0)), "postings")
    directory = store.where(F.col("term") == END).select("doc_id", "rk", F.col("pos").cast("bigint").alias("n_words"))
    lists = store.where(F.col("term") != END)
    second = seed.where("rank = 2").select("no", F.col("term").alias("term_2"), F.col("off").alias("off_2"))
    first = joined(lists, blocks(seed.where("rank = 1").join(second, "no", "left").drop("rank"), "no"), "term").withColumn("start", F.col("pos") - F.col("off"))
    begin, n = F.col("start") - F.col("ctx_at"), F.size("words")
    ends = (F.get("ctx", begin) == F.get("words", F.lit(0))) & (F.get("ctx", begin + n - 1) == F.get("words", n - 1))
    some = first.where(ends if slop is None else F.size(F.array_except("words", "ctx")) == 0)
    some = scratch.save(some.select("doc_id", "rk", "no", "words", "pos", "start", "ctx", "ctx_at", "term_2", (F.col("start") + F.col("off_2")).alias("pos_2")), "candidates")

    keys = some.where(F.col("term_2").isNotNull() & ends).select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("no").alias("p"), F.col("start").alias("s"), "term_2", "pos_2").distinct()
    row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r"))
    meet = lists.select("doc_id", "rk", "term", "pos").join(keys, row & (F.col("term") == F.col("term_2")) & (F.col("pos") == F.col("pos_2"))).select("d", "r", "p", "s").distinct()
    both = some.where("term_2 is not null").join(meet, row & (F.col("no") == F.col("p")) & (F.col("start") == F.col("s")), "left_semi").unionByName(some.where("term_2 is null"))
    exact = F.coalesce((F.col("start") >= 0) & (F.slice("ctx", F.greatest(begin, F.lit(0)) + 1, n) == F.col("words")), F.lit(False))
    out = both.where(exact).withColumn("kind", F.lit("phrase"))
    if slop is not None:
        near = some.where(~exact & _within(F.col("words"), F.col("ctx"), F.col("pos") - F.col("ctx_at"), n + slop))
        out = out.unionByName(near.withColumn("kind", F.lit("near")))
    named = out.join(known.select("no", "pid", "items"), "no")
    return directory, named.select("doc_id", "rk", "pid", "start", F.size("words").alias("n"), "items", "kind")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """doc_id, rk, n_words, n_hit, item_ids (sorted strings), n_near of every row of docs.

    A word is hit if an exact phrase match covers it. n_near counts the phrases of which a
    row has proximity matches only (none without slop). Repeated rows come back as often as they
    came; empty tables give no rows or no hits; other columns are ignored.
    """
    directory, found = matches(docs, items, text, doc_id, item_id, item_text, slop=slop)
    by_phrase = found.groupBy("doc_id", "rk", "pid").agg(F.collect_set(F.when(F.col("kind") == "phrase", F.col("start"))).alias("starts"), F.max("n").alias("n"), F.max("items").alias("items"))
    there = F.size("starts") > 0
    rows = by_phrase.groupBy(F.col("doc_id").alias("d"), F.col("rk").alias("r")).agg(
        F.collect_list(F.when(there, F.struct("starts", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(there, F.col("items")))))).alias("item_ids"), F.count(F.when(~there, True)).alias("n_near")
    )
    covered = F.flatten(F.transform("spans", lambda s: F.flatten(F.transform(s["starts"], lambda a: F.sequence(a, a + s["n"] - 1)))))
    rows = rows.withColumn("n_hit", F.size(F.array_distinct(covered)).cast("bigint"))
    both = directory.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r")), "left")
    zero = F.lit(0).cast("bigint")
    return both.select("doc_id", "rk", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_near", zero).alias("n_near"))
