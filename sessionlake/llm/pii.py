"""Personal data by a skip-chain conditional random field over number-like tokens.

Base spans come from fixed patterns. The field's nodes are the tokens that hold a digit or
an at sign; all other tokens are taken as observed to be no entity. Chain edges join
nodes that stand near each other, skip edges join each node to the last one before it of the same
or similar form (equal text or digits, equal last seven digits, equal half of a long number),
however far apart, so that repeated mentions share a potential. Loopy sum-product messages
give each node its label; nodes inside base spans are clamped, and their labels reach
look-alikes that the patterns miss: repeats in another notation or misspelt, and numbers that
the patterns lost as they ran into the next one.

Training is piecewise, on counts over the whole corpus: node shapes by label (a bounded
number of shapes) give a multinomial logistic model, label pairs on either kind of edge
give the pair potentials. The patterns label only what they match: a node outside every
base span that looks like one inside, or passes the same check, is unlabelled, not negative,
and left out of counts.

A document's nodes and edges are arrays, and messages go over them in blocks, so a text of a
million numbers takes some hundred bytes for each.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlake.llm.common import ship_code, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Tokens from one node to the next that a chain edge spans, at most; characters in between.
NEAR, NEAR_CHARS = 2, 64
ROUNDS, DAMP, SURE = 20, 0.5, 0.7
#: Edges whose messages are made at a time.
EDGE_BLOCK = 1 << 16
#: Added to the counts of label pairs and to those expected, so that rare pairs say little; equal
#: labels on a skip edge that are counted before any is seen.
SMOOTH, AGREE = 5.0, 20.0
BUCKETS = (0, 2, 5, 8, 11, 19)
#: Digits that one span of a kind may gather from several tokens; other kinds are of one token.
JOINED_DIGITS = {3: 19, 4: 15}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ACTIVE = re.compile(r"[0-9@]")
_NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, end, kind


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = text[done:at]
        size = len(left) - len(left.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if size else None
        done = at + 1
        if found:
            yield at - size, found.end()
            done = found.end()
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str, too_long: list[tuple[int, int]] | None = None) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind; failing matches are dropped.

    too_long gets those that fail as they run into further numbers.
    """
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
        elif too_long is not None and not 0 < len(digits) <= 19:
            too_long.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_NOT_DIGIT.sub("", m[0]))
            if 9 <= n <= 15:
                out.append((m.start(), m.end(), 3))
            elif too_long is not None and n > 15:
                too_long.append(m.span())
    return sorted(out, key=lambda s: (s[0], s[2]))


@dataclass
class Nodes:
    """The nodes of a document: places, labels (0: outside), numbers of their shapes, and the two kinds of edges."""

    begin: np.ndarray
    end: np.ndarray
    label: np.ndarray
    shape: np.ndarray
    shapes: list[tuple]
    chain: np.ndarray
    skip: np.ndarray


def _checked(token: str, digits: str) -> int:
    """0: nothing to check; 1: a card number or address that passes its check; 2: one that fails."""
    if 12 <= len(digits) <= 19 and digits in token:
        return 1 if luhn(digits) else 2
    parts = token.strip(".,;:!?()").split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        return 1 if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts) else 2
    return 0


def _own_shape(token: str, digits: str) -> tuple:
    n, check = len(digits), _checked(token, digits)
    size, letters = sum(n > b for b in BUCKETS), any(c.isalpha() for c in token)
    return ("@" in token, size, min(token.count("."), 4), token.startswith("+"), "(" in token, "-" in token, letters, check, size * 3 + check)


def forms(token: str, digits: str) -> list[str]:
    """What a node has in common with those that say the same or nearly so."""
    plain = _AT.sub("@", token.strip(".,;:!?()\"'")).lower()
    if "@" in plain or len(digits) < 3 or (plain[0].isalpha() and plain[-1].isalpha()):
        local = plain.partition("@")[0]
        return [plain] if local == plain or len(local) < 4 else [plain, local]
    out = [digits]
    if len(digits) > 7:
        half = len(digits) // 2
        out += [digits[-7:], f"{len(digits)}<{digits[:half]}", f"{len(digits)}>{digits[half:]}"]
    return out


def _links(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Edges from each node to the next one with an equal key."""
    order = np.argsort(keys, kind="stable")
    k, at = keys[order], owner[order]
    equal = (k[1:] == k[:-1]) & (at[1:] != at[:-1])
    code = np.unique(at[:-1][equal].astype(np.int64) * n + at[1:][equal])
    return np.stack([code // n, code % n], 1).astype(np.int32) if n else np.zeros((0, 2), np.int32)


def nodes_of(text: str, spans: list[Span]) -> Nodes:
    """Nodes with their features; inside a base span a node has the span's label, outside 0."""
    begin, end, label, own, near = array("q"), array("q"), array("b"), array("l"), array("b")
    keys, owner, shapes, at = array("q"), array("l"), {}, 0
    for m in _NODE.finditer(text):
        token, b, e = m[0], m.start(), m.end()
        while at < len(spans) and spans[at][1] <= b:
            at += 1
        k, mine = at, 0
        while k < len(spans) and spans[k][0] < e and not mine:
            mine = spans[k][2] + 1 if spans[k][1] > b else 0
            k += 1
        gap = len(_TOKEN.findall(text, end[-1], b)) + 1 if end and b - end[-1] <= NEAR_CHARS else NEAR + 1
        digits = _NOT_DIGIT.sub("", token)
        for form in forms(token, digits):
            keys.append(hash(form))
            owner.append(len(begin))
        begin.append(b)
        end.append(e)
        label.append(mine)
        near.append(min(gap, NEAR + 1))
        own.append(shapes.setdefault(_own_shape(token, digits), len(shapes)))
    n, known = len(begin), list(shapes)
    gaps, mine = np.array(near, np.int8), np.array(own, np.int64)
    sizes = np.array([s[1] for s in known] + [-1], np.int64)
    before, after = np.full(n, -1), np.full(n, -1)
    side = np.flatnonzero(gaps == 1)
    before[side], after[side - 1] = sizes[mine[side - 1]], sizes[mine[side]]
    code, shape = np.unique(mine * 64 + (before + 1) * 8 + (after + 1), return_inverse=True) if n else (np.zeros(0, np.int64), mine)
    full = [(*known[c // 64], int(c % 64 // 8 - 1), int(c % 8 - 1)) for c in code.tolist()]
    to = np.flatnonzero(gaps <= NEAR).astype(np.int32)
    return Nodes(np.array(begin, np.int64), np.array(end, np.int64), np.array(label, np.int8), shape.astype(np.int32), full, np.stack([to - 1, to], 1), _links(np.array(keys, np.int64), np.array(owner, np.int64), n))


@dataclass
class Field:
    """Potentials (logs): weights by shape feature and label, pair tables of both edges."""

    names: dict[tuple, int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, shapes: list[tuple]) -> np.ndarray:
        out = np.repeat(self.weights[-1:], len(shapes), 0)
        for i, shape in enumerate(shapes):
            out[i] += self.weights[[self.names[f] for f in enumerate(shape) if f in self.names]].sum(0)
        return out

    def marginals(self, nodes: Nodes, clamped: np.ndarray) -> np.ndarray:
        """Loopy sum-product in log space, damped; clamped nodes keep their label.

        An edge's messages, one either way, are the only state; both kinds of edges share a
        table each, and messages are renewed a block of edges at a time.
        """
        unary = self.unary(nodes.shapes).astype(np.float32)[nodes.shape]
        fixed = np.flatnonzero(clamped > 0)
        unary[fixed] = -30.0
        unary[fixed, clamped[fixed]] = 0.0
        groups = []
        for edges, table in ((nodes.chain, self.chain), (nodes.skip, self.skip)):
            for lo in range(0, len(edges), EDGE_BLOCK):
                part = edges[lo : lo + EDGE_BLOCK]
                groups.append((part[:, 0], part[:, 1], table.astype(np.float32), np.zeros((2, len(part), len(LABELS)), np.float32)))
        for _ in range(ROUNDS if groups else 0):
            belief, step = _gathered(unary, groups), 0.0
            for a, b, table, sent in groups:
                forth, back = sent[0].copy(), sent[1].copy()
                for k, (source, other, pairs) in enumerate(((a, back, table), (b, forth, table.T))):
                    new = np.logaddexp.reduce((belief[source] - other)[:, :, None] + pairs, axis=1)
                    new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                    step = max(step, float(np.abs(new - sent[k]).max()))
                    sent[k] = DAMP * sent[k] + (1 - DAMP) * new
            if step < 1e-3:
                break
        unary = _gathered(unary, groups)
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))


def _gathered(unary: np.ndarray, groups: list[tuple]) -> np.ndarray:
    """Node scores with all messages that reach them."""
    out = unary.copy()
    for a, b, _, sent in groups:
        np.add.at(out, b, sent[0])
        np.add.at(out, a, sent[1])
    return out


def unlabelled(nodes: Nodes, too_long: list[tuple[int, int]]) -> np.ndarray:
    """Nodes outside base spans that are neither positive nor negative.

    They look like one inside, pass a check, or are part of a match that failed as it was too long.
    """
    label = nodes.label
    out = (label == 0) & np.array([s[7] == 1 for s in nodes.shapes] + [False])[nodes.shape]
    for a, b in ((0, 1), (1, 0)):
        ends = nodes.skip[(label[nodes.skip[:, a]] > 0) & (label[nodes.skip[:, b]] == 0)] if len(nodes.skip) else nodes.skip
        out[ends[:, b]] = True
    for a, b in too_long:
        lo, hi = np.searchsorted(nodes.end, a, "right"), np.searchsorted(nodes.begin, b)
        out[lo:hi] |= label[lo:hi] == 0
    return out


def train(docs: DataFrame, text: str = "text") -> Field:
    """A field from counts over all documents: shapes and label pairs, added up by task."""

    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for t in batch.column("text"):
                value = t.as_py()
                too_long: list[tuple[int, int]] = []
                nodes = nodes_of(value, base_spans(value, too_long))
                known, label = ~unlabelled(nodes, too_long), nodes.label.astype(np.int64)
                code, n = np.unique(nodes.shape[known].astype(np.int64) * len(LABELS) + label[known], return_counts=True)
                for c, k in zip(code.tolist(), n.tolist(), strict=True):
                    tally["shape", ",".join(map(str, map(int, nodes.shapes[c // len(LABELS)]))), c % len(LABELS)] += k
                for name, edges in (("chain", nodes.chain), ("skip", nodes.skip)):
                    sure = edges[known[edges].all(1)] if len(edges) else edges
                    code, n = np.unique(label[sure[:, 0]] * len(LABELS) + label[sure[:, 1]], return_counts=True)
                    for c, k in zip(code.tolist(), n.tolist(), strict=True):
                        tally[name, str(c // len(LABELS)), c % len(LABELS)] += k
            kind, key, y = zip(*tally, strict=True) if tally else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.string()), pa.array(y, pa.int32()), pa.array(list(tally.values()), pa.int64())], names=["kind", "key", "y", "n"])

    some = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = sorted(tuple(r) for r in some.mapInArrow(run, "kind string, key string, y int, n bigint").groupBy("kind", "key", "y").agg(F.sum("n").alias("n")).collect())  # one row for each shape and label
    pairs = {k: np.zeros((len(LABELS), len(LABELS))) for k in ("chain", "skip")}
    pairs["skip"] += AGREE * np.eye(len(LABELS))
    shapes, ys, ns = [], [], []
    for kind, key, y, n in rows:
        if kind == "shape":
            shapes.append(tuple(map(int, key.split(","))))
            ys.append(y)
            ns.append(n)
        else:
            pairs[kind][int(key), y] += n
    tables = {}
    for k, p in pairs.items():
        p = p + p.T if k == "skip" else p
        expected = p.sum(1, keepdims=True) * p.sum(0, keepdims=True) / max(p.sum(), 1.0)
        tables[k] = np.log((p + SMOOTH) / (expected + SMOOTH))
    names = {f: i for i, f in enumerate(sorted({f for s in shapes for f in enumerate(s)}))}
    return Field(names, _logistic(shapes, ys, ns, names), tables["chain"], tables["skip"])


def _logistic(shapes: list[tuple], ys: list[int], ns: list[int], names: dict, steps: int = 600) -> np.ndarray:
    """Multinomial logistic weights (last row: bias) by full-batch Adam steps with L2."""
    w = np.zeros((len(names) + 1, len(LABELS)))
    if not shapes:
        w[-1, 0] = 5.0
        return w
    x = np.zeros((len(shapes), len(names) + 1))
    for i, s in enumerate(shapes):
        x[i, [names[f] for f in enumerate(s)]] = 1
    x[:, -1] = 1
    y, n = np.eye(len(LABELS))[ys], np.sqrt(np.array(ns, float))[:, None]
    n /= n.sum()
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        g = x.T @ (n * (p - y)) + 1e-4 * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return w


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field finds outside the base spans."""
    nodes = nodes_of(text, base)
    label = nodes.label.astype(np.int64)
    if not (label == 0).any():
        return []
    p = field.marginals(nodes, label)
    best = p.argmax(1)
    best[(p.max(1) < SURE) | (label > 0)] = 0
    out: list[tuple] = []
    for i in np.flatnonzero(best).tolist():
        a, b, k = int(nodes.begin[i]), int(nodes.end[i]), int(best[i])
        digits = len(_NOT_DIGIT.sub("", text[a:b]))
        if out and out[-1][3] == i - 1 and out[-1][2] == k - 1 and out[-1][4] + digits <= JOINED_DIGITS.get(k, 0) and text[out[-1][1] : a].strip("\t ") == "":
            out[-1] = (out[-1][0], b, k - 1, i, out[-1][4] + digits)
        else:
            out.append((a, b, k - 1, i, digits))
    trimmed, at = [], 0
    reach = np.maximum.accumulate(np.array([s[1] for s in base], np.int64)) if base else np.zeros(0, np.int64)
    for a, b, k, *_ in out:
        b = a + len(text[a:b].rstrip(".,;:!?*#%&$|\"'"))
        while at < len(base) and base[at][0] < b:
            at += 1
        if b > a and (at == 0 or reach[at - 1] <= a):
            trimmed.append((a, b, k))
    return trimmed


def mask(text: str, spans: list[Span]) -> str:
    """text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k]}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), field: Field | None = None) -> DataFrame:
    """``doc`` (a struct of the kept columns), spans and masked text for every row.

    Offsets are code points, end exclusive; spans go by start, then kind. Null and empty texts have
    no spans. Without a field one is trained on docs; on an empty table, or one without a
    match, it adds nothing. Rows that repeat are treated alike. A text of any length is one
    field; its nodes take some hundred bytes each. An empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    field = field or train(docs, text)
    some = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)
    out = StructType().add(some.schema["doc"]).add("spans", StructType.fromDDL(f"spans {SPANS}")["spans"].dataType).add("masked", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in (s for b in batches for s in slices(b)):
            spans, masked = [], []
            for t in batch.column("text"):
                value, found = t.as_py(), []
                if _ACTIVE.search(value):
                    base = base_spans(value)
                    found = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(value, base, sent.value)], key=lambda s: (s[0], s[2], s[1]))
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": o} for a, b, k, o in found])
                masked.append(mask(value, [s[:3] for s in found]) if found else value)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, pa.list_(row)), pa.array(masked, pa.string())], names=["doc", "spans", "masked"])

    return some.mapInArrow(run, out)
