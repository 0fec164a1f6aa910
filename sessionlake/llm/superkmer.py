"""Substring dedup on words by super-k-mer partitioning.

Windows of 20 words; a super-k-mer is a run of windows that share a minimiser (a five-word
gram), packed as one string and sent to the minimiser's bucket. There the strings come
sorted by minimiser and place, so the first time a window is seen is its earliest start,
and every later one is a repetition. Windows are compared as their exact bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import Scratch, row_key, ship_code, slices, word_chunks
from sessionlake.llm.windows import MANY, SIEVE_BITS, Runs, mix, ranges, removed, repetitions, runs_of, with_spans

WINDOW = 20
#: Words in a gram, by round; see windows.
GRAMS = (5, 13, 18, 20)
GRAM = GRAMS[0]


def stretches(text: bytes, gram: int = GRAM) -> Iterator[tuple[int, list[bytes], Runs]]:
    """(first word's number, words, super-k-mers) for bounded stretches of a text."""
    base, words = 0, []
    for more in word_chunks(text):
        words += more
        if len(words) < WINDOW:
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        n = len(words) - gram + 1
        grams = h[:n].copy()
        for k in range(1, gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        yield base, words, runs_of(mix(grams), WINDOW - gram + 1)
        done = len(words) - WINDOW + 1
        base, words = base + done, words[done:]


class Bucket:
    """Goes through the super-k-mers of a bucket, sorted by key, doc_id, rk and start.

    Of equal strings of a hot minimiser the first goes to the next round.
    """

    def __init__(self):
        self.key = self.held = self.last = None
        self.windows: set[bytes] = set()
        self.whole: set[bytes] = set()

    def add(self, hot: bool, key: int, place: tuple, n: int, at: int, times: int, packed: bytes) -> list[tuple]:
        """Spans of repeated words as (doc_id, rk, lo, hi, 0, null), strings for the next round with 1 and text."""
        if (hot, key) != self.key:
            self.key, self.held, self.last = (hot, key), None, None
            self.windows, self.whole = set(), set()
        if place == self.last:
            return []
        self.last = place
        if packed in self.whole:
            return [(*place, place[2] + n + WINDOW - 1, 0, None)]
        fresh = not self.whole
        self.whole.add(packed)
        if hot:
            return [(*place, place[2], 1, packed)]
        if fresh and at != MANY:
            self.held = packed
            return []
        if self.held is not None:
            self.expand(self.held)
            self.held = None
        return [(*place[:2], place[2] + lo, place[2] + hi, 0, None) for lo, hi in self.expand(packed)]

    def expand(self, packed: bytes) -> list[tuple[int, int]]:
        at = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
        begin, end = [0, *(at + 1).tolist()], [*at.tolist(), len(packed)]
        flags = np.zeros(len(begin) - WINDOW + 1, bool)
        for i in range(len(flags)):
            window = packed[begin[i] : end[i + WINDOW - 1]]
            if window in self.windows:
                flags[i] = True
            else:
                self.windows.add(window)
        return [(lo, hi + WINDOW - 1) for lo, hi in ranges(flags)]

    def flush(self) -> list[tuple]:
        return []


class Words:
    """How words are cut, packed and compared; places go in order, so the first one stays."""

    window, grams, first_stays, order = WINDOW, GRAMS, True, ("doc_id", "rk", "start")

    def stretches(self, text: bytes, gram: int) -> Iterator[tuple[int, list[bytes], Runs]]:
        return stretches(text, gram)

    def pack(self, words: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(words[a:b])

    def bucket(self, gram: int) -> Bucket:
        return Bucket()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) of every row.

    The earliest start is the one of smallest doc_id (null before all), then, among rows
    that share a doc_id, smallest row hash, then position. Rows equal in doc_id and text
    are one document and are returned as often as they come. Null and blank texts have no
    words; long texts are cut in stretches that share no window. An empty table gives no rows;
    other columns are ignored.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(text).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    found = repetitions(rows, Words(), scratch, sieve_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for t, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (t.as_py() or b"").split()
                gone = removed(len(words), spans.as_py())
                out.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)))
            n, k, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(rows, found).mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
