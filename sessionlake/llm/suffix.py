"""Suffix-array dedup on bytes: every 200-byte string that starts at two places goes.

Texts are cut into super-k-mers (runs of 200-byte windows that share a minimiser), which
meet in the minimiser's bucket. Equal super-k-mers repeat as a whole; what differs is
joined into one text whose suffix array shows the windows that two of them share. The
array is built by linear grouping: suffixes are first grouped by their Lyndon prefix,
groups taken in descending order and lower ones split along previous-smaller pointers;
then each suffix, in ascending order, puts those whose next smaller suffix it is to the
front of their groups. No names are assigned and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import Scratch, row_key, ship_code, slices
from sessionlake.llm.windows import MANY, SIEVE_BITS, Runs, mix, ranges, removed, repetitions, runs_of, with_spans

WINDOW = 200
#: Bytes in a gram, by round; see windows.
GRAMS = (32, 128, 184, 200)
GRAM = GRAMS[0]
#: Two windows are compared only if they agree around the minimiser but for so many bytes.
SLACK = 21
STRETCH = 1 << 18


def group_suffixes(text: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Phase 1: (array, group, prev). group[i] is where i's group begins in the array.

    Groups end up ordered and made of the suffixes that share a Lyndon prefix; prev[i] is
    the last position before i in a lower group, or -1.
    """
    n = len(text)
    array = np.argsort(text, kind="stable")
    first = np.concatenate([[True], text[array][1:] != text[array][:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    begin = np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    group, where = np.empty(n, np.int64), np.empty(n, np.int64)
    group[array], where[array] = begin, np.arange(n)
    size = dict(zip(starts.tolist(), np.diff(np.concatenate([starts, [n]])).tolist(), strict=True))
    array, group, where, prev = array.tolist(), group.tolist(), where.tolist(), [-1] * n
    top = n
    while top:
        g = group[array[top - 1]]
        members = array[g:top]
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            levels = ((j,),) if j >= 0 else ()
        else:
            members.sort()
            tally: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    tally[j] = tally.get(j, 0) + 1
            if not tally:
                levels = ()
            elif max(tally.values()) == 1:
                levels = (tally,)
            else:
                by: dict[int, list[int]] = {}
                for j, k in tally.items():
                    by.setdefault(k, []).append(j)
                levels = tuple(by[k] for k in sorted(by, reverse=True))
        for level in levels:
            moved: dict[int, list[int]] = {}
            for j in level:
                h = group[j]
                last = h + size[h] - 1
                at, other = where[j], array[last]
                array[at], array[last] = other, j
                where[other], where[j] = at, last
                size[h] -= 1
                if h in moved:
                    moved[h].append(j)
                else:
                    moved[h] = [j]
            for h, js in moved.items():
                new = h + size[h]
                size[new] = len(js)
                for j in js:
                    group[j] = new
        top = g
    return array, group, prev


def suffix_array(text: np.ndarray) -> list[int]:
    """Phase 2: the suffixes of text in ascending order (an end sorts before every symbol)."""
    array, group, prev = group_suffixes(text)
    n = len(array)
    front, placed = list(range(n)), [False] * n

    def chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            at = front[group[j]]
            front[group[j]] = at + 1
            array[at], placed[j] = j, True
            j = prev[j]

    chain(n - 1)
    for k in range(n):
        chain(array[k] - 1)
    return array


def shared_windows(texts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each text, which of its windows also start elsewhere in these texts."""
    whole = b"".join(t + b"\0" for t in texts)
    symbols = np.frombuffer(whole, np.uint8).astype(np.int32) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols[ends] = 0
    begins = ends - np.array([len(t) for t in texts])
    left = np.repeat(ends, np.array([len(t) + 1 for t in texts])) - np.arange(len(whole))
    order = np.array(suffix_array(symbols))
    order = order[left[order] >= window].tolist()
    flags, before, text = np.zeros(len(whole), bool), None, b""
    for at in order:
        now = whole[at : at + window]
        if now == text:
            flags[at] = flags[before] = True
        before, text = at, now
    return [flags[b : b + max(len(t) - window + 1, 0)] for b, t in zip(begins.tolist(), texts, strict=True)]


def candidates(texts: list[bytes], places: list[int], gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(text number, begin, end): the parts that may share a window with another text.

    places: the minimiser's place in each text. A window that begins o bytes before it holds
    the o bytes to its left and WINDOW - gram - o to its right, and so does every equal window;
    the bytes that all o of one step of SLACK have in common are looked up first.
    """
    room = WINDOW - gram
    steps = [(lo, min(lo + SLACK, room)) for lo in range(0, max(room, 1), SLACK)]
    seen: dict[tuple[int, bytes], int] = {}
    hit: dict[int, list[int]] = {}
    for i, (t, at) in enumerate(zip(texts, places, strict=True)):
        for j, (lo, hi) in enumerate(steps):
            left, right = at - lo, at + WINDOW - hi
            if left < 0 or right > len(t):
                continue
            other = seen.setdefault((j, t[left:right]), i)
            if other != i:
                hit.setdefault(other, []).append(j)
                hit.setdefault(i, []).append(j)
    out = []
    for i, js in hit.items():
        at = places[i]
        out.append((i, max(0, at - steps[max(js)][1]), min(len(texts[i]), at - steps[min(js)][0] + WINDOW)))
    return out


def stretches(text: bytes, gram: int = GRAM) -> Iterator[tuple[int, bytes, Runs]]:
    """(first byte, bytes, super-k-mers) for bounded stretches of a text; gram is a multiple of 8."""
    for base in range(0, max(len(text) - WINDOW + 1, 0), STRETCH):
        part = text[base : base + STRETCH + WINDOW - 1]
        n = len(part) - gram + 1
        grams = None
        for k in range(0, gram, 8):
            eight = np.ndarray((n,), "<u8", part, k, (1,))
            grams = eight * np.uint64(0x9E3779B97F4A7C15) if grams is None else (grams ^ (grams >> np.uint64(29)) ^ eight) * np.uint64(0xBF58476D1CE4E5B9)
        yield base, part, runs_of(mix(grams), WINDOW - gram + 1)


class Bucket:
    """Goes through the super-k-mers of a bucket, sorted by key, packed and place.

    Places of a string that is known to repeat are given out at once; of every other string
    one place is held until its key ends, when the strings are compared. Of a hot minimiser
    the strings, each once, go to the next round instead.
    """

    def __init__(self, gram: int):
        self.gram, self.key = gram, None
        self.texts: list[bytes] = []
        self.places: list[tuple | None] = []
        self.ats: list[int] = []
        self.held = None

    def add(self, hot: bool, key: int, place: tuple, n: int, at: int, times: int, packed: bytes) -> list[tuple]:
        """Spans of repeated bytes as (doc_id, rk, lo, hi, 0, null), strings for the next round with times and text."""
        out = self.flush() if (hot, key) != self.key else []
        self.key = (hot, key)
        if self.texts and self.texts[-1] == packed:
            first, known = self.held
            if place != first:
                if known == 1:
                    out.append((*first, first[2] + len(packed), 0, None))
                if times == 1 and place != self.last:
                    out.append((*place, place[2] + len(packed), 0, None))
                self.held, self.places[-1] = (first, 2), None
        else:
            if hot:
                out += self.flush()
            self.texts.append(packed)
            self.ats.append(at)
            self.places.append(place if times == 1 else None)
            self.held = (place, times)
        self.last = place
        return out

    def flush(self) -> list[tuple]:
        out, some = [], []
        if self.key and self.key[0]:
            out = [(*self.held[0], self.held[0][2], self.held[1], t) for t in self.texts]
        elif any(p is not None for p in self.places):
            if MANY in self.ats:
                some = [(i, 0, len(t)) for i, t in enumerate(self.texts)]
            elif len(self.texts) > 1:
                some = candidates(self.texts, self.ats, self.gram)
        if any(self.places[i] is not None for i, _, _ in some):
            for (i, begin, _), flags in zip(some, shared_windows([self.texts[i][a:b] for i, a, b in some]), strict=True):
                place = self.places[i]
                if place is not None:
                    out += [(*place[:2], place[2] + begin + lo, place[2] + begin + hi + WINDOW - 1, 0, None) for lo, hi in ranges(flags)]
        self.texts, self.places, self.ats = [], [], []
        return out


class Bytes:
    """How bytes are cut, packed and compared; every place of a string that repeats goes."""

    window, grams, first_stays, order = WINDOW, GRAMS, False, ("packed", "doc_id", "rk", "start")

    def stretches(self, text: bytes, gram: int) -> Iterator[tuple[int, bytes, Runs]]:
        return stretches(text, gram)

    def pack(self, part: bytes, a: int, b: int) -> bytes:
        return part[a:b]

    def bucket(self, gram: int) -> Bucket:
        return Bucket(gram)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed [lo, hi)), kept (binary) of every row.

    Every row is a document, also one whose doc_id is null or repeats: what rows share is removed
    from each, so of rows equal in doc_id and text nothing stays but texts too short for a
    string. Null and short texts lose nothing; long ones are cut in stretches that share no
    string. An empty table gives no rows; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(text).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    found = repetitions(rows, Bytes(), scratch, sieve_bits)
    equal = rows.groupBy("doc_id", "rk").agg(F.count("*").alias("times"), F.max(F.octet_length("text")).cast("bigint").alias("hi")).where((F.col("times") > 1) & (F.col("hi") >= WINDOW))
    found = found.unionByName(equal.select("doc_id", "rk", F.lit(0).cast("bigint").alias("lo"), "hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for t, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = t.as_py() or b""
                gone = removed(len(data), spans.as_py())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), [{"lo": lo, "hi": hi} for lo, hi in ranges(gone)], kept))
            n, k, where, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(where, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return with_spans(rows, found).mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<lo:bigint,hi:bigint>>, kept binary")
