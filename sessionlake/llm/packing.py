"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids are cut into full
windows, which are closed at once, and a rest, which goes to the open window it fits best;
if none fits, a new window is opened, and when the number is reached the fullest is closed
first. What is still open at a partition's end is merged: the leftovers of a fixed number
of partitions are packed again, largest first. Memory is bounded by the open windows.

Ids come from the tokenizers file. Where a rank file of the same vocabulary is given, texts
are encoded with it, which is faster and gives the same ids; texts that hold a special
token's string or a very long unbroken run still go through the tokenizers file.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import Scratch, ship_code

LENGTH, OPEN_WINDOWS, MERGE_PARTITIONS = 2048, 64, 8
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


@lru_cache(maxsize=4)
def encoder(path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, without added tokens."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    encode_slow = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return encode_slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = re.compile("|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values()) or r"(?!)")

    def encode(text: str) -> np.ndarray:
        if special.search(text) or (len(text) >= 2000 and _LONG_RUN.search(text)):
            return encode_slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


class Packer:
    """Best-fit over a bounded number of open windows; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, length: int, windows: int | None):
        self.next, self.length, self.windows = first_id, length, windows
        self.gaps: list[tuple[int, int]] = []
        self.open: dict[int, list] = {}
        self.made = 0

    def close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray, start: int = 0, total: int | None = None) -> Iterator[tuple]:
        total = len(ids) if total is None else total
        at = 0
        while len(ids) - at >= self.length:
            yield from self.close([(doc_id, start + at, ids[at : at + self.length], total)])
            at += self.length
        rest = len(ids) - at
        if not rest:
            return
        piece = (doc_id, start + at, ids[at:], total)
        k = bisect.bisect_left(self.gaps, (rest, -1))
        if k < len(self.gaps):
            gap, window = self.gaps.pop(k)
            self.open[window].append(piece)
            if gap == rest:
                yield from self.close(self.open.pop(window))
                return
        else:
            if self.windows and len(self.gaps) >= self.windows:
                yield from self.close(self.open.pop(self.gaps.pop(0)[1]))
            gap, window = self.length, self.made
            self.made += 1
            self.open[window] = [piece]
        bisect.insort(self.gaps, (gap - rest, window))

    def rest(self) -> Iterator[list]:
        while self.gaps:
            yield self.open.pop(self.gaps.pop(0)[1])


def _batch(rows: list[tuple], kind: pa.DataType, extra: dict) -> pa.RecordBatch:
    doc_id, start, ids, total, seq, at = zip(*rows, strict=True)
    cols = {
        "doc_id": pa.array(doc_id, kind), "start": pa.array(start, pa.int64()), "ids": pa.array([np.ascontiguousarray(x, "<u4").tobytes() for x in ids], pa.binary()),
        "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(at, pa.int64()),
    }
    cols |= {k: pa.array([v] * len(rows), pa.int64()) for k, v in extra.items()}
    return pa.RecordBatch.from_pydict(cols)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 1, length: int = LENGTH, windows: int = OPEN_WINDOWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    One row for each piece; a document's ids and end_id lie in exactly one piece each. Null
    and empty texts are end_id alone; repeated rows and null ids are packed like any other;
    a long text is cut into as many windows as it fills; an empty table gives no rows. Windows that stay short are to be padded to length.
    sequence_id holds the partition in its upper bits, so none is given twice.
    """
    ship_code(docs.sparkSession)
    name = docs.schema[doc_id].dataType.simpleString()
    columns = f"doc_id {name}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId()
        packer, out, size, kind = Packer(part << 33, length, windows), [], 0, pa.int64()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids, kind = batch.column("doc_id").to_pylist(), batch.schema.field("doc_id").type
            for d, t in zip(ids, batch.column("text"), strict=True):
                for row in packer.add(d, np.concatenate([encode(t.as_py() or ""), end])):
                    out.append(row)
                    size += len(row[2])
                    if size >= 1 << 20:
                        yield _batch(out, kind, {"merge": -1})
                        out, size = [], 0
        if out:
            yield _batch(out, kind, {"merge": -1})
        for pieces in packer.rest():
            yield _batch([(*p, -1, -1) for p in pieces], kind, {"merge": part // MERGE_PARTITIONS})

    def merge(table: pa.Table) -> pa.Table:
        group, kind = table.column("merge")[0].as_py(), table.schema.field("doc_id").type
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("start").to_pylist(), table.column("ids").to_pylist(), table.column("doc_tokens").to_pylist(), strict=True), key=lambda r: (-len(r[2]), r[0] is None, r[0], r[1]))
        packer = Packer(((1 << 29) + group) << 33, length, None)
        out = [x for d, s, ids, total in rows for x in packer.add(d, np.frombuffer(ids, "<u4"), s, total)]
        for pieces in packer.rest():
            out += packer.close(pieces)
        return pa.Table.from_batches([_batch(out, kind, {})])

    packed = Scratch(docs.sparkSession).save(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{columns}, merge bigint"), "packed")
    merged = packed.where("merge >= 0").groupBy("merge").applyInArrow(merge, columns)
    return packed.where("merge < 0").drop("merge").unionByName(merged)
