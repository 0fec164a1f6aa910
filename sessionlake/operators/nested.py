"""Merging JSON documents key by key, and taking elements out of their arrays, many documents in one plan.

Documents are taken apart a level at a time, and only where both sides hold an object; what is settled goes on as the
text of a whole branch. Joins are by document and path, so the keys of one large document are spread over tasks,
and a document is one row again in the last steps only. Shuffles have a number of partitions that grows with the
documents' text, so that no task holds more of it as it grows. Keys come back in order of their names, as variants keep
them, arrays in their own order, unknown keys unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.scratch import Scratch

#: Path of keys; None stands for any key.
Path = tuple[str | None, ...]
_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"
#: Of the documents' text for each task; apart and with paths it takes some forty times that.
TASK_BYTES = 8 << 20


def _saved(scratch: Scratch, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text) of the documents, without what isn't JSON."""
    return scratch.save(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.try_parse_json("text").isNotNull()), "documents")


def _parts(*saved: DataFrame) -> int:
    """Partitions for shuffles of these documents."""
    size = sum(d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for d in saved)
    return max(saved[0].sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def _roots(saved: DataFrame, n: int) -> DataFrame:
    """(id, path, v): one document for each id, of several the one whose text is greatest."""
    best = saved.repartition(n, "id").groupBy("id").agg(F.max("text").alias("text"))
    return best.select("id", F.array().cast("array<string>").alias("path"), F.try_parse_json("text").alias("v"))


def _members(v: str) -> Column:
    return F.try_variant_get(v, "$", _OBJECT)


def _elements(v: str) -> Column:
    return F.try_variant_get(v, "$", _ARRAY)


def _at(paths: list[Path]) -> Column:
    """Whether the column path is one of paths."""
    hits = [reduce(Column.__and__, [F.get("path", F.lit(i)) == k for i, k in enumerate(p) if k is not None], F.size("path") == len(p)) for p in paths]
    return reduce(Column.__or__, hits, F.lit(False))


def _joined(pieces: Column, left: str, right: str) -> Column:
    """The texts of sorted pieces in brackets."""
    return F.concat(F.lit(left), F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["text"]), ","), F.lit(right))


def _put_together(settled: DataFrame, depth: int, n: int) -> DataFrame:
    """(id, text) of branches (id, path, text), from the deepest level up."""
    level = settled.where(F.size("path") == depth)
    for d in range(depth, 0, -1):
        key = F.element_at("path", -1)
        quoted = F.to_json(F.array(key))
        piece = F.struct(key.alias("key"), F.concat(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), "text").alias("text"))
        pieces = level.select("id", F.slice("path", 1, d - 1).alias("above"), piece.alias("piece")).repartition(n, "id", "above")
        above = pieces.groupBy("id", "above").agg(_joined(F.col("piece"), "{", "}").alias("text"))
        level = above.withColumnRenamed("above", "path").unionByName(settled.where(F.size("path") == d - 1))
    return level.select("id", "text")


def _united(both: DataFrame, key: Callable[[Column], Column], n: int) -> DataFrame:
    """(id, path, text): b's elements, then those of o whose key b lacks, the first of each key."""

    def side(v: str) -> DataFrame:
        rows = both.select(F.struct("id").alias("k"), "path", F.posexplode(_elements(v)).alias("pos", "e"))
        return rows.select("k", "path", F.lit(v).alias("side"), "pos", F.coalesce(key(F.col("e")), F.lit("")).alias("key"), F.to_json("e").alias("text"))

    base, known = side("b"), side("b").select(*[F.col(c).alias(f"{c}_") for c in ("k", "path", "key")]).repartition(n, "k_", "path_", "key_").distinct()
    new = side("o").repartition(n, "k", "path", "key").groupBy("k", "path", "side", "key").agg(F.min(F.struct("pos", "text")).alias("first")).select("k", "path", "side", "first.pos", "key", "first.text")
    new = new.join(known, (F.col("k") == F.col("k_")) & (F.col("path") == F.col("path_")) & (F.col("key") == F.col("key_")), "left_anti")
    found = base.unionByName(new).select("k.id", "path", F.struct("side", "pos", "text").alias("piece")).repartition(n, "id", "path").groupBy("id", "path").agg(_joined(F.col("piece"), "[", "]").alias("text"))
    empty = both.where((F.size(_elements("b")) == 0) & (F.size(_elements("o")) == 0)).select("id", "path", F.lit("[]").alias("text"))
    return found.unionByName(empty)


def merge_documents(base: DataFrame, override: DataFrame, arrays: list[Path] | None = None, key: Callable[[Column], Column] = F.to_json, doc_id: str = "id", text: str = "text") -> DataFrame:
    """(id, text): override's documents over base's of the same id.

    Where both hold an object, it is merged key by key; at one of the paths arrays, where both hold an array, base's
    elements are followed by those of override whose key base's lack, once for each key (a null key is an empty one);
    everywhere else override's value stands, also a null. An id of one side only keeps its document.
    Null ids are equal. Of several documents of an id and side the one whose text is greatest counts; null,
    empty and malformed texts count as no document. Two empty tables give no rows; other columns are ignored.
    """
    scratch, settled, depth = Scratch(base.sparkSession), [], 0
    docs = [_saved(scratch, d, doc_id, text) for d in (base, override)]
    n = _parts(*docs)
    sides = [_roots(d, n) for d in docs]
    while True:
        by = ("k", "path") if depth else ("k",)  # the roots' one path drops out of the join, which would then be dealt out anew
        b = sides[0].select(F.struct("id").alias("k"), "path", F.col("v").alias("b")).repartition(n, *by)  # a null within a struct is equal to another
        o = sides[1].select(F.struct("id").alias("k_"), F.col("path").alias("path_"), F.col("v").alias("o")).repartition(n, *[f"{c}_" for c in by])
        both = b.join(o, (F.col("k") == F.col("k_")) & (F.col("path") == F.col("path_")), "full")
        both = both.select(F.coalesce("k", "k_")["id"].alias("id"), F.coalesce("path", "path_").alias("path"), F.col("path").isNotNull().alias("in_b"), F.col("path_").isNotNull().alias("in_o"), "b", "o")
        united = F.lit(False) if not arrays else _at(arrays) & _elements("b").isNotNull() & _elements("o").isNotNull()
        both = scratch.save(both.withColumn("how", F.when(_members("b").isNotNull() & _members("o").isNotNull(), F.lit("open")).when(united, F.lit("array")).otherwise(F.lit("whole"))), "level")
        settled.append(both.where("how = 'whole'").select("id", "path", F.to_json(F.when(F.col("in_o"), F.col("o")).otherwise(F.col("b"))).alias("text")))
        if arrays:
            settled.append(_united(both.where("how = 'array'"), key, n))
        opened = both.where("how = 'open'")
        settled.append(opened.where((F.size(_members("b")) == 0) & (F.size(_members("o")) == 0)).select("id", "path", F.lit("{}").alias("text")))
        if opened.isEmpty():
            return _put_together(reduce(DataFrame.unionByName, settled), depth, n)
        sides = [opened.select("id", "path", F.explode(_members(v)).alias("key", "v")).select("id", F.array_append("path", F.col("key")).alias("path"), "v") for v in ("b", "o")]
        depth += 1


def remove_elements(docs: DataFrame, arrays: list[Path], texts: Callable[[Column], Column], parts: list[str], doc_id: str = "id", text: str = "text") -> DataFrame:
    """(id, text, n_removed): documents without the elements, at the paths arrays, one of whose texts holds one of parts.

    texts gives an element's array of strings; nulls in it hold nothing. An array that is then empty goes, and
    so does an object with nothing left; empty objects elsewhere stay, and a document with nothing left is {}. Ids, texts
    and empty tables are taken as in merge_documents. No parts: nothing is removed but empty arrays.
    """
    scratch, settled, deepest = Scratch(docs.sparkSession), [], max(map(len, arrays), default=0)
    saved = _saved(scratch, docs, doc_id, text)
    n = _parts(saved)
    ids = scratch.save(_roots(saved, n), "roots")
    level = ids
    for depth in range(deepest + 1):
        opened = (F.size(_members("v")) > 0) & F.lit(depth < deepest)
        settled.append(level.where(~F.coalesce(opened, F.lit(False))))
        inside = level.where(opened).select("id", "path", F.explode(_members("v")).alias("key", "v"))
        level = inside.select("id", F.array_append("path", F.col("key")).alias("path"), "v")
    rows = scratch.save(reduce(DataFrame.unionByName, settled).withColumn("here", _at(arrays) & _elements("v").isNotNull()), "branches")
    elements = rows.where("here").select("id", "path", F.posexplode(_elements("v")).alias("pos", "e"))
    gone = F.exists(texts(F.col("e")), lambda t: F.coalesce(reduce(Column.__or__, [t.contains(p) for p in parts], F.lit(False)), F.lit(False)))
    elements = scratch.save(elements.select("id", "path", "pos", F.to_json("e").alias("text"), F.coalesce(gone, F.lit(False)).alias("gone")), "elements")
    pieces = elements.where("not gone").select("id", "path", F.struct("pos", "text").alias("piece")).repartition(n, "id", "path")
    kept = pieces.groupBy("id", "path").agg(_joined(F.col("piece"), "[", "]").alias("text"))
    whole = _put_together(kept.unionByName(rows.where("not here").select("id", "path", F.to_json("v").alias("text"))), deepest, n)
    counts = elements.where("gone").select(F.struct("id").alias("k")).repartition(n, "k").groupBy("k").agg(F.count("*").alias("n"))
    whole = whole.select(F.struct("id").alias("k"), F.col("text").alias("text_w")).repartition(n, "k")
    out = ids.select(F.struct("id").alias("k")).repartition(n, "k").join(whole, "k", "left").join(counts, "k", "left")
    return out.select("k.id", F.coalesce("text_w", F.lit("{}")).alias("text"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"))
