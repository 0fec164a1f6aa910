"""SimHash near-duplicate classes by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight bytes. Two fingerprints that differ in at most two bits
differ in at most two bytes, so they share at least six positional bytes: that is the
guaranteed minimum of the count filter.

A list of a single positional byte holds 1/256 of all fingerprints, too many to form its pairs.
But where two bytes may differ, of any three groups of positions one is shared whole; so lists
are kept by the bytes of a group, which are intersections of single lists. Inside a list every other
position is indexed by its bytes, and each posting adds one to the tally of its pairs. Pairs whose tally
reaches the minimum are retained, and only those are compared bit by bit. A list of more than LONG fingerprints is parted by the same
argument on the positions that are left, until six are shared; then it holds at most
65,536 fingerprints that differ in two bytes, whose neighbours are looked up. Lists hold distinct
fingerprints; each yields its links as a forest, which keeps the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import Scratch, ship_code, slices, word_chunks

BYTES, WIDTH = 8, 3
MAX_BITS = 2
MIN_SHARED = BYTES - MAX_BITS
#: Fingerprints of a list up to which its pairs are tallied in one task.
LONG = 1024
#: Pairs, as squares of sizes, of the lists that are tallied at once.
PAIRS = 1 << 21
MASKS = np.array([sum(1 << b for b in c) for n in (1, 2) for c in combinations(range(16), n)], np.uint16)


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); no words: zero."""
    total, tally, tail = 0, np.zeros(64, np.int64), []

    def add(hashes: list[int]) -> None:
        nonlocal total
        for lo in range(0, len(hashes), 1 << 16):
            h = np.array(hashes[lo : lo + (1 << 16)], np.uint64)
            tally[:] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)

    h64 = xxhash.xxh64_intdigest
    for words in word_chunks((text or b"").lower()):
        words = tail + words
        add(list(map(h64, map(b" ".join, zip(words, words[1:], words[2:], strict=False)), repeat(42))))
        tail = words[-2:] if len(words) > 1 else words
    if not total:
        if not tail:
            return 0
        add([h64(b" ".join(tail), 42)])
    return int(np.packbits(tally * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; the bits of fp are the fingerprint's."""
    ship_code(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def groups(shared: int) -> tuple[int, ...]:
    """Sets of positions, one of which a pair that shares the set shared has in common too.

    Sets are bit masks. The positions that are left are cut in three; none if two or fewer are left.
    """
    left = [p for p in range(BYTES) if not shared >> p & 1]
    if len(left) <= MAX_BITS:
        return ()
    cut = [0, -(-len(left) // 3), len(left) - len(left) // 3, len(left)]
    return tuple(shared | sum(1 << p for p in left[a:b]) for a, b in zip(cut, cut[1:], strict=False))


def _all_groups() -> dict[int, tuple[int, ...]]:
    known, todo = {}, [0]
    while todo:
        mask = todo.pop()
        if mask not in known:
            known[mask] = groups(mask)
            todo += known[mask]
    return known


GROUPS = _all_groups()


def _lookup(values: dict[int, Column], mask: str) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v)])[F.col(mask)]


def postings(rows: DataFrame) -> DataFrame:
    """(mask, part, fp): rows (fp, mask) posted under each group of positions of their mask, by the bytes there."""
    whole = {m: int(np.uint64(sum(255 << 8 * p for p in range(BYTES) if m >> p & 1)).view(np.int64)) for m in GROUPS}
    children = _lookup({m: F.array(*map(F.lit, g)) for m, g in GROUPS.items() if g}, "mask")
    out = rows.select("fp", F.explode(children).alias("mask")).distinct()
    return out.select("mask", F.col("fp").bitwiseAND(_lookup({m: F.lit(v).cast("bigint") for m, v in whole.items()}, "mask")).alias("part"), "fp")


def tally(fps: np.ndarray, number: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared): pairs of fingerprints of a list, by index, with the positional bytes that they share.

    number and mask: each fingerprint's list and the positions that the list has in common. Every other
    position is an inverted index: fingerprints are posted under list and byte, and each posting adds one to its
    pairs. A pair that shares nothing beyond its list is in no posting and isn't given.
    """
    u, found = fps.view(np.uint64), [np.zeros(0, np.int64)]
    for p in range(BYTES):
        rows = np.flatnonzero(mask >> p & 1 == 0)
        key = number[rows] << 8 | (u[rows] >> np.uint64(8 * p) & np.uint64(255)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        at, step = np.arange(len(key)), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[key[at + step] == key[at]]
            found.append(rows[at] * len(fps) + rows[at + step])
            step += 1
    pairs, counts = np.unique(np.concatenate(found), return_counts=True)
    a, b = np.divmod(pairs, max(len(fps), 1))
    return a, b, counts + np.bitwise_count(mask[a]).astype(np.int64)


def near(fps: np.ndarray, number: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the count filter retains and whose bits, compared last, differ in MAX_BITS at most."""
    a, b, shared = tally(fps, number, mask)
    a, b = a[shared >= MIN_SHARED], b[shared >= MIN_SHARED]
    u = fps.view(np.uint64)
    good = np.bitwise_count(u[a] ^ u[b]) <= MAX_BITS
    return a[good], b[good]


def neighbours(mask: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one list that shares six positions, so that the filter retains all of it: neighbours are looked up."""
    lo, hi = (p for p in range(BYTES) if not mask >> p & 1)
    u = fps.view(np.uint64)
    open_bits = (((u >> np.uint64(8 * lo)) & np.uint64(255)) | (((u >> np.uint64(8 * hi)) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
    order = np.argsort(open_bits)
    known, left, right = open_bits[order], [], []
    for bits in MASKS:
        place = np.minimum(np.searchsorted(known, known ^ int(bits)), len(known) - 1)
        at = np.flatnonzero((known[place] == known ^ int(bits)) & (np.arange(len(known)) < place))
        left.append(order[at])
        right.append(order[place[at]])
    return np.concatenate(left), np.concatenate(right)


def portions(sizes: np.ndarray) -> Iterator[slice]:
    """Stretches of lists that hold PAIRS pairs at most, or one list."""
    total, start = 0, 0
    for k, n in enumerate((sizes * sizes).tolist()):
        if total and total + n > PAIRS:
            yield slice(start, k)
            total, start = 0, k
        total += n
    if len(sizes):
        yield slice(start, len(sizes))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links a-b that join what is not joined yet."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            out.append((x, y))
    return out


def list_links(lists: DataFrame) -> DataFrame:
    """(a, b): the links of lists (mask, fps), a forest for each batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            masks, sizes = batch.column("mask").to_numpy(), np.diff(batch.column("fps").offsets.to_numpy()).astype(np.int64)
            fps, ends, found = batch.column("fps").flatten().to_numpy(), np.cumsum(sizes), []
            full = np.bitwise_count(masks) >= MIN_SHARED
            for some in portions(np.where(full, 0, sizes)):
                at = np.arange(*(ends[some][-1] - sizes[some].sum(), ends[some][-1]))
                number, mask = (np.repeat(x[some], sizes[some]) for x in (np.arange(len(sizes)), masks))
                at, number, mask = (x[~full[number]] for x in (at, number, mask))
                a, b = near(fps[at], number, mask)
                found.append((at[a], at[b]))
            for k in np.flatnonzero(full).tolist():
                at = int(ends[k] - sizes[k])
                a, b = neighbours(int(masks[k]), fps[at : at + sizes[k]])
                found.append((a + at, b + at))
            a, b = (fps[np.concatenate(x)] for x in zip(*found, strict=True)) if found else (fps[:0], fps[:0])
            links = forest(a, b)
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("mask", "fps").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to keep every component."""
    ship_code(distinct.sparkSession)
    scratch, out = Scratch(distinct.sparkSession), []
    rows, last = distinct.select("fp", F.lit(0).alias("mask")), [m for m, g in GROUPS.items() if not g]
    while True:
        posted = postings(rows)
        sizes = posted.groupBy("mask", "part").agg(F.count("*").alias("size")).where("size > 1")
        posted = scratch.save(posted.join(sizes, ["mask", "part"]), "postings")
        whole = (F.col("size") <= LONG) | F.col("mask").isin(last)
        out.append(list_links(posted.where(whole).groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"))))
        rows = posted.where(~whole).select("fp", "mask")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, out)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star rounds.

    Each round is two min-aggregations and joins, written to the shared folder; edges that
    repeat are dropped before they are shuffled on. Ends when a round changes nothing.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.save(small, "edges") if before[0] else edges
        now = state(after) if before[0] else before
        if now == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        scratch.drop(edges)
        edges, before = after, now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each row with its class; component_id is the smallest doc_id.

    Fingerprints link at two or fewer differing bits, and components are transitive. Null
    and blank texts have fingerprint zero and link like any other. Rows that repeat, also in
    doc_id, come back as often as they came. A null doc_id never names a component unless
    nothing else is in it. Texts are read whole, a megabyte at a time. An empty table gives no
    rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, doc_id, text), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(scratch, links(classes.select("fp")))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = scratch.save(named.join(names, "root").select("fp", "component_id"), "members")
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")
