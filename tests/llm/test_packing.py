from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from helpers import docs, empty
from tokenizers import Tokenizer

from sessionlake.llm import packing, queries

FILES = queries.tokenizer_files()


def test_rank_file_gives_the_same_ids():
    rng, plain = random.Random(9), Tokenizer.from_file(FILES["tokenizer"])
    fast = packing.encoder(FILES["tokenizer"], FILES["ranks"], FILES["pattern"])
    bits = ["a", "the ", " ", "\n", "é", "日本", "'s", "123", "<|endoftext|>", "!!", "\t", " ", "😀", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 5000, " " * 5000, "\n" * 3000 + "x"]
    for t in texts:
        assert fast(t).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:80])


def check(rows, pieces, ids_of, length=2048):
    """Every id in exactly one piece, sequences gapless and not too long; returns the share of padding."""
    seqs, want, got = defaultdict(list), defaultdict(int), defaultdict(int)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        seqs[p.sequence_id].append((p.offset, len(ids)))
        got[(p.doc_id, p.doc_tokens, p.start, tuple(ids))] += 1
    for d, t in rows:
        want[(d, tuple([*ids_of(t or ""), 1]))] += 1
    whole = defaultdict(int)
    by = defaultdict(list)
    for (d, total, start, ids), n in got.items():
        by[(d, total)] += [(start, ids)] * n
    for (d, total), parts in by.items():
        docs_here = [(i, k) for (x, i), k in want.items() if x == d and len(i) == total]
        for ids, k in docs_here:
            cover = sorted(start for start, part in parts if ids[start : start + len(part)] == part)
            assert cover and cover[0] == 0
            whole[(d, ids)] += k
        assert sum(len(p) for _, p in parts) == sum(len(i) * k for i, k in docs_here)
    assert whole == want
    used = padded = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= length
        used += at
        padded += length - at if at & (at - 1) else 0
    return padded / max(used + padded, 1)


def test_packing(spark):
    rng, plain = random.Random(10), Tokenizer.from_file(FILES["tokenizer"])
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1", "é"]) for _ in range(int(rng.paretovariate(0.7)) % 6000))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "null id"), (402, "x " * 20_000), (7, rows[7][1]), (8, "other")]
    pieces = packing.pack(docs(spark, rows, 4), **FILES).collect()
    share = check(rows, pieces, lambda t: plain.encode(t, add_special_tokens=False).ids)
    assert share < 0.05
    assert packing.pack(empty(spark), **FILES).count() == 0


def test_bounded_space():
    rng, packer, most = random.Random(11), packing.Packer(0, 100, 8), 0
    out = []
    for d in range(2000):
        out += packer.add(d, np.arange(rng.randint(1, 250), dtype=np.uint32))
        most = max(most, len(packer.open))
    assert most <= 8
    for pieces in packer.rest():
        out += packer.close(pieces)
    full = defaultdict(int)
    for _, _, ids, _, seq, _ in out:
        full[seq] += len(ids)
    assert max(full.values()) <= 100 and sum(full.values()) / (100 * len(full)) > 0.85


def test_query(spark):
    """The registered query: every id once, as the tokenizers file has it, by its checksum."""
    sf, plain = "/root/testdata/sf0.001", Tokenizer.from_file(FILES["tokenizer"])
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in queries.op10_packing(spark, sf).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [*((by[d], len(x)) for d, x in ids.items()), *((p, None) for p in seqs.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 2048
