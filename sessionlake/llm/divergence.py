"""How the sources of a language differ in their terms, and by which terms.

Terms are counted by (language, source), tallied in each task before any shuffle. The terms
that enough of a language's documents have are pivoted: one row for each term, its counts in an
array indexed by the language's sources. Everything after that works on these rows alone: a
term's smoothed shares, its contribution to every pair of sources and to every source against
the whole language are made by higher-order functions in the JVM, and the contributions to pairs
are summed before they are shuffled. Shares are whole numbers out of SCALE and all arithmetic is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import Scratch, ship_code, within

#: A term's share of its source, in parts of this.
SCALE = 1_000_000_000
#: Added to each count; twice as much, times the terms, to their sum.
PRIOR = 2
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Terms of all sources that a task tallies before it passes them on.
_FLUSH = 300_000


def terms(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number of bytes at a time; only A-Z are lower-cased, as bytes are."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            found = _GAP.search(data, end)
            end = found.start() if found else len(data)
        yield _TERM.findall(data[at:end].lower())
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with any, of (lang, source, text), tallied in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in said.items():
                names, d = list(n), held[lang, source]
                for lo in range(0, len(names), 10_000):
                    some = names[lo : lo + 10_000]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            said.clear()
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                n, d, own = said.setdefault((lang, source), Counter()), held.setdefault((lang, source), Counter()), set()
                was = len(n)
                for some in terms(text.as_py()):
                    n.update(some)
                    own.update(some)
                d.update(own)
                size += len(n) - was
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_places(docs: DataFrame) -> DataFrame:
    """(lang, source, at, width): each source's place among those of its language, in order of name."""
    names = docs.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("names"))
    return names.select("lang", F.size("names").alias("width"), F.posexplode("names").alias("at", "source"))


def term_vectors(counts: DataFrame, places: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, counts): of every kept term how often each source has it, by the source's place."""
    held = counts.join(places, ["lang", "source"]).groupBy("lang", "term")
    held = held.agg(F.sum("docs").alias("docs"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("cells")).where(F.col("docs") >= min_docs)
    zeros = lambda k: F.array_repeat(F.lit(0).cast("bigint"), k)
    before = lambda i: F.coalesce(F.get("cells", i - 1)["at"], F.lit(-1))
    filled = F.flatten(F.transform("cells", lambda c, i: F.concat(zeros(c["at"] - before(i) - 1), F.array(c["n"]))))
    return held.select("lang", "term", F.concat(filled, zeros(F.col("width") - 1 - F.element_at("cells", -1)["at"])).alias("counts"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), by decimals, so that no corpus is too large."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return 1 + F.call_function("div", up, (total + PRIOR * terms).cast("decimal(19,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)) of two shares; the square of SCALE is within a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part ``pair``: the other sources of the language by how far their term shares are from this
    one's, summed over all kept terms. Part ``term``: the top terms that the source has more of, by
    share, than its language. A language keeps the terms that min_docs of its rows have. Ranks
    start at 1 and go by value, then by item.

    Null languages, sources and texts are empty ones, and empty names are names like any other.
    Sources without terms have pairs too; languages without kept terms have pairs of value 0 and
    no terms. Repeated rows count as often as they come; an empty table gives no rows; other
    columns are ignored. Long texts are read whole, a piece at a time. The result has a row for
    each ordered pair of sources of a language: that square is the output asked for, and is
    the only thing that grows so.
    """
    ship_code(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    scratch = Scratch(docs.sparkSession)
    places = scratch.save(source_places(named), "places")
    vectors = scratch.save(term_vectors(term_counts(named), within(places), min_docs), "vectors")

    cells = vectors.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    sums = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "total"))).alias("s"), F.first("terms").alias("terms"))
    sums = scratch.save(sums.select("lang", "terms", F.transform("s", lambda z: z["total"]).alias("totals"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, z: a + z["total"]).alias("total")), "sums")
    whole = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    shares = vectors.join(within(sums), "lang").select(
        "lang", "term", "counts", F.zip_with("counts", "totals", lambda n, t: share(n, t, F.col("terms"))).alias("p"), share(whole, F.col("total"), F.col("terms")).alias("q")
    )
    shares = scratch.save(shares, "shares")
    return _pairs(shares, places).unionByName(_terms(shares, places, top))


def _pairs(shares: DataFrame, places: DataFrame) -> DataFrame:
    """Every ordered pair of sources with the sum of their terms' contributions, which are made once for both orders."""
    later = lambda i: F.slice("p", i + 2, F.size("p"))
    of_place = lambda p, i: F.transform(later(i), lambda q, k: F.struct(i.alias("a"), (i + k + 1).alias("b"), apart(p, q).alias("f")))
    made = shares.select("lang", F.explode(F.flatten(F.transform("p", of_place))).alias("c"))
    one_way = made.groupBy("lang", "c.a", "c.b").agg(F.sum("c.f").alias("value"))
    both = one_way.select("lang", F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("other"), "value"), F.struct(F.col("b").alias("at"), F.col("a").alias("other"), "value"))).alias("r")).select("lang", "r.*")
    sides = places.select("lang", "at", "source").join(places.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), "lang").where("at <> other")
    rows = sides.join(both, ["lang", "at", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    rank = F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(shares: DataFrame, places: DataFrame, top: int) -> DataFrame:
    """The top terms of every source against its language; the filter on the rank reaches below the shuffle."""
    cells = shares.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("at", "c")).where((F.col("c.counts") > 0) & (F.col("c.p") > F.col("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item"))
    best = cells.select("lang", "at", F.col("term").alias("item"), apart(F.col("c.p"), F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(places.select("lang", "at", "source"), ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
