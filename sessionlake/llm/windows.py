"""Super-k-mers: runs of consecutive windows that share a minimiser, sent as one string.

Used by the two substring operators, on words and on bytes. A window's minimiser is the
gram of least hash in it, so equal windows have equal minimisers wherever they stand, and
meet in one bucket. A sieve goes before the shuffle: super-k-mers are counted by their
minimiser, and those that are alone cannot share a window with any other, so they are not
sent. A crowded sieve only sends more.

A minimiser that HOT super-k-mers or more have is hot. Its super-k-mers do not meet in one
bucket: equal ones are first brought down to few, spread over tasks by string and salt, and
what is left differs and goes to the next round, where it is cut up anew by longer grams.
Longer grams part what differs near the minimiser, so ever fewer strings share one; in the
last round a gram is a whole window, and only equal strings meet. So a bucket holds fewer
than HOT super-k-mers (times SALT in the last round, all equal), whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import Scratch

#: 2 ** SIEVE_BITS bits (16 MB), twice, reach the driver and each task, however large the input.
#: That serves some 10 ** 8 super-k-mers; of more, an ever larger share passes, up to all, which
#: costs about as much as an exact filter by shuffle would. A larger sieve is a parameter.
SIEVE_BITS, BLOCK_BITS = 27, 19
#: Super-k-mers of one minimiser that make it hot; tasks that equal strings of a hot one are dealt to.
HOT, SALT = 2000, 64
#: Marks a super-k-mer that holds its minimiser more than once.
MANY = -1
_U = np.uint64


@dataclass
class Runs:
    """Super-k-mers of a stretch: first window, number of windows, minimiser, its place, repeated inside.

    The place is the minimiser's first; where it is repeated inside, others follow.
    """

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    place: np.ndarray
    multi: np.ndarray

    def slots(self, n_bits: int) -> np.ndarray:
        return (self.key & _U((1 << n_bits) - 1)).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs_of(grams: np.ndarray, per_window: int) -> Runs:
    """Super-k-mers from gram hashes; per_window grams make a window, len(grams) >= per_window."""
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= per_window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < per_window:
        gap = per_window - width
        low = np.minimum(low[:-gap], low[gap:])
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    key = grams[at[start]]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(fresh)
    ends = np.concatenate([start[first[1:]], [len(at)]]) if len(first) else start
    multi = np.diff(np.concatenate([first, [len(start)]])) > 1
    return Runs(start[first], ends - start[first], key[first], at[start[first]], multi)


@dataclass
class Sieve:
    """Bitmaps of the slots that hold a minimiser of two super-k-mers or more, and a hot one.

    A slot may stand for several minimisers; that only sends more, or parts more finely.
    """

    n_bits: int
    bits: np.ndarray
    hot: np.ndarray

    def _at(self, bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1

    def passes(self, slots: np.ndarray) -> np.ndarray:
        return self._at(self.bits, slots)

    def is_hot(self, slots: np.ndarray) -> np.ndarray:
        return self._at(self.hot, slots)


def build_sieve(keys: DataFrame, scratch: Scratch, n_bits: int) -> Sieve:
    """The sieve of (key bigint, n bigint), n added up by key."""
    crowded = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2")
    slots = crowded.groupBy(F.col("key").bitwiseAND(F.lit((1 << n_bits) - 1)).alias("slot")).agg((F.max("n") >= HOT).alias("hot"))
    blocks = slots.select(F.shiftright("slot", BLOCK_BITS).cast("int").alias("block"), F.col("slot").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("bit"), "hot")

    def fill(table: pa.Table) -> pa.Table:
        out = {"block": table.column("block")[:1]}
        bit, hot = table.column("bit").to_numpy(), table.column("hot").to_numpy()
        for name, at in (("bits", bit), ("hot", bit[hot])):
            flags = np.zeros(1 << BLOCK_BITS, bool)
            flags[at] = True
            out[name] = pa.array([np.packbits(flags, bitorder="little").tobytes() if len(at) else None], pa.binary())
        return pa.table(out)

    whole = [np.zeros(1 << (max(n_bits, BLOCK_BITS) - 3), np.uint8) for _ in range(2)]
    size = 1 << (BLOCK_BITS - 3)
    filled = scratch.save(blocks.groupBy("block").applyInArrow(fill, "block int, bits binary, hot binary"), "sieve")
    for row in filled.toLocalIterator():
        for array, data in zip(whole, (row.bits, row.hot), strict=True):
            if data is not None:
                array[row.block * size : (row.block + 1) * size] = np.frombuffer(data, np.uint8)
    scratch.drop(filled)
    return Sieve(n_bits, *whole)


def count_keys(parts: DataFrame, stretches: Callable[[bytes], Iterator[tuple[int, Any, Runs]]]) -> DataFrame:
    """(key, n): super-k-mers by minimiser, added up within each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for t in batch.column("text"):
                for _, _, r in stretches(t.as_py() or b""):
                    found.append(np.repeat(r.key, np.where(r.multi, 2, 1)))
                    size += len(found[-1])
                if size >= 1 << 19:
                    yield tally(found)
                    found, size = [], 0
            if found:
                yield tally(found)

    def tally(found: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return parts.select("text").mapInArrow(run, "key bigint, n bigint")


def send(parts: DataFrame, op: Any, gram: int, sieve: Sieve, last: bool) -> DataFrame:
    """Super-k-mers that pass the sieve; packed is null for a repetition found at once.

    Of equal strings in one batch the earliest is sent on. Each other one is a repetition,
    and so, if op.first_stays is false, is the earliest; repetitions carry n, their number of windows,
    and adjoining ones are joined. times is 2 where the string's own place is done already.
    """
    kind = parts.schema["doc_id"].dataType.simpleString()
    sent = parts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            type_ = batch.schema.field("doc_id").type
            best: dict[bytes, list] = {}
            done: list[list] = []
            size = 0

            def repeated(row: list, done: list[list]) -> None:
                (_, d, rk, start), n = row[:2]
                if done and done[-1][:2] == [d, rk] and done[-1][2] + done[-1][3] == start:
                    done[-1][3] += n
                else:
                    done.append([d, rk, start, n])

            for d, rk, base, times, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rk", "base", "times")), batch.column("text"), strict=True):
                for at, part, r in op.stretches(t.as_py() or b"", gram):
                    slots = r.slots(sent.value.n_bits)
                    hot = sent.value.is_hot(slots)
                    for k in np.flatnonzero(sent.value.passes(slots)).tolist():
                        a, n = int(r.start[k]), int(r.count[k])
                        packed = op.pack(part, a, a + n + op.window - 1)
                        mine = [(d is not None, d, rk, base + at + a), n, int(r.key[k].view(np.int64)), MANY if r.multi[k] else int(r.place[k]) - a, times, bool(hot[k])]
                        other = best.get(packed)
                        if other is None:
                            best[packed] = mine
                            size += len(packed)
                        elif other[0] != mine[0]:
                            if mine[0] < other[0]:
                                best[packed], mine, other = mine, other, mine
                            if mine[4] == 1:
                                repeated(mine, done)
                            if not op.first_stays:
                                if other[4] == 1:
                                    repeated(other, done)
                                other[4] = 2
                if size >= 1 << 24 or len(done) >= 1 << 16:
                    yield emit(best, done, type_)
                    best, done, size = {}, [], 0
            if best or done:
                yield emit(best, done, type_)

    def emit(best: dict, done: list, type_: pa.DataType) -> pa.RecordBatch:
        rows = [(rk, False, d, rk, start, n, MANY, 2, None) for d, rk, start, n in done]
        for packed, ((_, d, rk, start), n, key, at, times, hot) in best.items():
            hot = hot and not last
            if hot:
                key = xxhash.xxh64_intdigest(packed, rk % SALT) - (1 << 63)
            rows.append((key, hot, d, rk, start, n, at, times, packed))
        kinds = (pa.int64(), pa.bool_(), type_, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "hot", "doc_id", "rk", "start", "n", "at", "times", "packed"])

    return parts.mapInArrow(run, f"key bigint, hot boolean, doc_id {kind}, rk bigint, start bigint, n bigint, at int, times int, packed binary")


def compared(sent: DataFrame, op: Any, gram: int) -> DataFrame:
    """(doc_id, rk, lo, hi, times, text): spans of repetitions (times 0), and what goes to the next round."""
    kind = sent.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, type_ = op.bucket(gram), pa.int64()

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = (type_, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "rk", "lo", "hi", "times", "text"])

        for batch in batches:
            type_, out = batch.schema.field("doc_id").type, []
            doc, rk, start, n, key, hot, at, times, packed = (batch.column(c).to_pylist() for c in ("doc_id", "rk", "start", "n", "key", "hot", "at", "times", "packed"))
            for i, value in enumerate(packed):
                place = (doc[i], rk[i], start[i])
                if value is None:
                    out.append((*place, start[i] + n[i] + op.window - 1, 0, None))
                else:
                    out += bucket.add(hot[i], key[i], place, n[i], at[i], times[i], value)
            if out:
                yield made(out)
        if out := bucket.flush():
            yield made(out)

    return sent.repartition("key").sortWithinPartitions("hot", "key", *op.order).mapInArrow(run, f"doc_id {kind}, rk bigint, lo bigint, hi bigint, times int, text binary")


def repetitions(rows: DataFrame, op: Any, scratch: Scratch, n_bits: int) -> DataFrame:
    """(doc_id, rk, lo, hi): the spans of rows (doc_id, rk, text) that repeat, by rounds of op.grams."""
    parts, spans = rows.select("doc_id", "rk", F.lit(0).cast("bigint").alias("base"), F.lit(1).alias("times"), "text"), []
    for k, gram in enumerate((*op.grams, op.grams[-1])):
        sieve = build_sieve(count_keys(parts, lambda t, g=gram: op.stretches(t, g)), scratch, n_bits)
        found = scratch.save(compared(send(parts, op, gram, sieve, k == len(op.grams)), op, gram), "repeated")
        spans.append(found.where("times = 0").select("doc_id", "rk", "lo", "hi"))
        if not sieve.hot.any():
            break
        parts = found.where("times > 0").select("doc_id", "rk", F.col("lo").alias("base"), "times", "text")
    return reduce(DataFrame.unionByName, spans)


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, rk, text) with spans, the collected (lo, hi) of found, or null."""
    spans = found.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), "spans")
    return docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r")), "left").select("doc_id", "text", "spans")


def removed(n: int, spans: list[dict] | None) -> np.ndarray:
    """A flag for each of n units, true where some span covers it."""
    step = np.zeros(n + 1, np.int64)
    for s in spans or ():
        step[s["lo"]] += 1
        step[s["hi"]] -= 1
    return np.cumsum(step[:n]) > 0
