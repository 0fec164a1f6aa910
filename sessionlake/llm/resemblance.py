"""Links between texts that resemble each other: Jaccard similarity of word-shingle sets.

A SimHash of 64 bits can't find these: at similarity 0.8 about ten bits differ, and eight
positional bytes guarantee nothing beyond seven. So the inverted index holds shingles, and the
count filter is the prefix filter: if two sets of at most n shingles are alike, they share
c = ceil(0.8 * n) at least, and in any order of all shingles the first n - c + k of
either hold the first k shared ones. Nothing is left to chance, and no pair is dropped.

First, k = n / 10 in order of hash: a sieve counts these prefixes' shingles over the corpus, and
a text whose prefix has fewer than that many shingles that occur elsewhere is alike to none. What
is left is ordered by number of texts, rarest first, and posted under its first n - c + 1
shingles, so a common passage is in the lists of those texts only that consist of little else.
A list whose members are in different components is compared with one of them, some times over,
which joins most near copies; then its pairs that are in different components still, and whose
places in the order let them share enough, are compared too. Every candidate is verified on the
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import Scratch, ship_code, slices, within, word_chunks
from sessionlake.llm.simhash import components, fingerprint
from sessionlake.llm.simhash import links as simhash_links
from sessionlake.llm.windows import SIEVE_BITS, Sieve, build_sieve, mix

SHINGLE, SIMILARITY = 5, 0.8
#: The share of a set's shingles that the sieve has to find elsewhere.
EXTRA = 0.1
#: Times that lists are compared with one member before pairs are: any member, or one from outside the first component.
HEADS = 3
#: Members of a list that one task pairs with as many others.
CHUNK = 1024
#: Bits of a set's parity sketch: each is whether the number of shingles that hash to it is odd.
SKETCH = 512
_U = np.uint64
_SLOT = _U((1 << SIEVE_BITS) - 1)


def node(text: Column) -> Column:
    """Equal texts are one node."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the lower-cased shingles, sorted; fewer words make one shingle, none an empty set."""
    found, tail = [], np.zeros(0, _U)
    for words in word_chunks((text or b"").lower()):
        h = np.concatenate([tail, np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))])
        n = len(h) - width + 1
        if n > 0:
            g = h[:n].copy()
            for k in range(1, width):
                g = g * _U(0x9E3779B97F4A7C15) + h[k : k + n]
            found.append(mix(g))
        tail = h[max(n, 0) :]
    if not found and len(tail):
        g = _U(len(tail)) + np.zeros(1, _U)
        for x in tail:
            g = mix(g * _U(0x9E3779B97F4A7C15) + x)
        found.append(g)
    return np.unique(np.concatenate(found)) if found else tail


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two shingle sets reaches the threshold; empty sets are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def least_shared(n: int, similarity: float) -> int:
    """Shingles that a set of n has in common with every set alike, at least."""
    return int(np.ceil(n * similarity - 1e-9))


def extra(n: int) -> int:
    return max(1, int(np.ceil(n * EXTRA - 1e-9)))


def sieve_prefix(grams: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles by hash, as many as hold extra(n) of the shared ones."""
    n = len(grams)
    return grams[: n - least_shared(n, similarity) + extra(n)] if n else grams


def sketches(docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """(node, fp, prefix) of every text, prefix being 64-bit shingles; equal texts of a batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            rows = {}
            for n, t in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                if n not in rows:
                    value = t.as_py()
                    rows[n] = (fingerprint(value), sieve_prefix(shingles(value, width), similarity).tobytes())
            fps, found = zip(*rows.values(), strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(np.array(fps, _U).view(np.int64)), pa.array(found, pa.binary())], names=["node", "fp", "prefix"])

    return docs.select(node(F.col(text)).alias("node"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "node bigint, fp bigint, prefix binary")


def count_prefixes(found: DataFrame) -> DataFrame:
    """(key, n): texts by shingle of their prefix, added up within each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            whole = np.frombuffer(b"".join(x.as_py() for x in batch.column("prefix")), _U)
            key, n = np.unique(whole, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return found.select("prefix").mapInArrow(run, "key bigint, n bigint")


def parity(grams: np.ndarray) -> bytes:
    """A sketch of which two differ in no more bits than their sets differ in shingles."""
    odd = np.bincount((grams >> _U(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def sets_left(docs: DataFrame, text: str, sieve: Sieve, width: int, similarity: float) -> DataFrame:
    """(node, n, grams, sketch) of the texts that the sieve leaves, each once."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            rows: dict[int, np.ndarray | None] = {}
            for n, t in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                if n not in rows:
                    grams = shingles(t.as_py(), width)
                    found = sent.value.passes((sieve_prefix(grams, similarity) & _SLOT).astype(np.int64)).sum()
                    rows[n] = grams if len(grams) and found >= extra(least_shared(len(grams), similarity)) else None
            left = {n: g for n, g in rows.items() if g is not None}
            sizes = [len(g) for g in left.values()]
            flat = pa.array(np.concatenate(list(left.values())).view(np.int64) if left else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            odd = pa.array([parity(g) for g in left.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(left), pa.int64()), pa.array(sizes, pa.int32()), lists, odd], names=["node", "n", "grams", "sketch"])

    some = docs.select(node(F.col(text)).alias("node"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "node bigint, n int, grams array<bigint>, sketch binary")
    return some.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("sketch").alias("sketch"))


def postings(sets: DataFrame, similarity: float) -> DataFrame:
    """(gram, node, n, at): the index. at is the shingle's place in the order of its text, from 0.

    Shingles that no other text left has come first in that order, but are not posted.
    """
    tokens = sets.select("node", "n", F.explode("grams").alias("gram"))
    counts = tokens.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int")
    shared = tokens.join(counts, "gram").groupBy("node", "n").agg(F.collect_list(F.struct("df", "gram")).alias("g")).where(F.size("g") >= least)
    first = F.col("n") - F.size("g")
    some = shared.select("node", "n", first.alias("first"), F.slice(F.array_sort("g"), F.lit(1), F.greatest(F.col("n") - least + 1 - first, F.lit(0))).alias("g"))
    return some.select("node", "n", "first", F.posexplode("g").alias("k", "g")).select("g.gram", "node", "n", (F.col("first") + F.col("k")).alias("at"))


def may_be_alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two postings (n, at) of a list leave room for enough shared shingles, if theirs is the first."""
    return F.least(a["n"] - a["at"], b["n"] - b["at"]) >= (a["n"] + b["n"]) * F.lit(similarity / (1 + similarity)) - 1e-9


def verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those pairs of nodes whose sets are alike; sets that are in no pair are not moved."""
    ids = within(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = sets.join(ids, "node", "left_semi")
    sides = [sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([x.values.to_numpy() for x in batch.column(c)] for c in ("ga", "gb"))
            good = [alike(x, y, similarity) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ga", "gb").mapInArrow(run, "a bigint, b bigint")


def across(lists: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of postings in different components that may be alike.

    lists: members (node, n, at, root, chunk, sketch) of two chunks of a list, or of one and the
    same. A pair is left out if its places leave no room for enough shared shingles, or if its
    sketches differ in more bits than sets that are alike do in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for members in batch.column("members"):
                ids, n, at, root, chunk = (members.values.field(k).to_numpy() for k in ("node", "n", "at", "root", "chunk"))
                odd = np.frombuffer(b"".join(members.values.field("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
                mixed = chunk.min() != chunk.max()
                for i in range(len(ids) - 1):
                    rest = slice(i + 1, None)
                    least = np.ceil((n[rest] + n[i]) * (similarity / (1 + similarity)) - 1e-9)
                    fits = (root[rest] != root[i]) & (np.minimum(n[rest] - at[rest], n[i] - at[i]) >= least)
                    if mixed:
                        fits &= chunk[rest] != chunk[i]
                    some = np.flatnonzero(fits)
                    some = some[np.bitwise_count(odd[rest][some] ^ odd[i]).sum(1) <= (n[rest] + n[i] - 2 * least)[some]]
                    other = ids[rest][some]
                    found.append(np.stack([np.minimum(other, ids[i]), np.maximum(other, ids[i])], 1))
                    size += len(other)
                if size >= 1 << 16:
                    yield emit(found)
                    found, size = [], 0
            if size:
                yield emit(found)

    def emit(found: list) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return lists.select("members").mapInArrow(run, "a bigint, b bigint")


def alike_links(docs: DataFrame, found: DataFrame, text: str, width: int, similarity: float, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): components of edges and of the pairs that are alike; found: sketches of docs."""
    sieve = build_sieve(count_prefixes(found), scratch, SIEVE_BITS)
    sets = scratch.save(sets_left(docs, text, sieve, width, similarity), "sets")
    posted = scratch.save(postings(sets, similarity), "index")
    long = posted.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    index = scratch.save(posted.join(long, "gram"), "lists")
    scratch.drop(posted)
    entry = F.struct("node", "n", "at", "root")
    roots = None
    for k in range(HEADS):
        members = index.withColumn("root", F.col("node")) if roots is None else index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = members.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        some = members.join(mixed, "gram").where(F.lit(k % 2 == 0) | (F.col("root") != F.col("lo")))
        mixed = some.groupBy("gram").agg(F.min_by(entry, F.xxhash64("node", F.lit(k))).alias("head"))
        pairs = members.select("gram", entry.alias("e")).join(mixed, "gram").where((F.col("e.root") != F.col("head.root")) & may_be_alike(F.col("e"), F.col("head"), similarity))
        pairs = scratch.save(pairs.select(F.least("e.node", "head.node").alias("a"), F.greatest("e.node", "head.node").alias("b")).distinct(), "pairs")
        good = scratch.save(verified(sets, pairs, similarity), "links")
        if roots is not None and good.isEmpty():
            continue
        known = edges if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(scratch, known.unionByName(good))
    if roots is None:
        roots = components(scratch, edges)

    members = scratch.save(index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    mixed = members.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    parts = members.join(mixed, "gram").join(sets.select("node", "sketch"), "node").withColumn("chunk", F.pmod(F.hash("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    parts = parts.groupBy("gram", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).agg(F.collect_list(F.struct("node", "n", "at", "root", "chunk", "sketch")).alias("members"))
    rest = scratch.save(across(parts, similarity).distinct(), "pairs")
    more = scratch.save(verified(sets, rest, similarity), "links")
    if not more.isEmpty():
        roots = components(scratch, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    for table in (sets, index, members):
        scratch.drop(table)
    return roots


def classes(docs: DataFrame, text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the components of more than one text; every node but the root itself is listed.

    Texts link if their shingle sets have the similarity, or if their SimHash fingerprints
    link as in simhash.near_duplicates. Null is the empty text; texts without words link.
    """
    ship_code(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(sketches(docs, text, width, similarity), "sketches")
    prints = scratch.save(found.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = simhash_links(prints.select("fp"))
    for c in "ab":
        near = near.join(prints.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")), c)
    same = found.join(prints, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = scratch.save(near.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(same).distinct(), "near")
    roots = alike_links(docs, found, text, width, similarity, edges, scratch)
    for table in (found, prints, edges):
        scratch.drop(table)
    return roots
