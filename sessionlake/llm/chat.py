"""Chat formatting with typed content parts.

A message's content is an ordered list of typed parts. ``PartVisitor`` has one method for
each type: text goes into the output escaped, an image, audio or document part leaves an
ordered placeholder and a record of what it refers to and how many tokens it stands for
once expanded. The template marks turns with control strings; a text that contains
them is escaped reversibly, so ``parse_parts`` reads turns and parts back exactly, and a text that
looks like a placeholder stays a text.

Escaping: any ``<``, n backslashes, ``|`` becomes the same with n + 1 backslashes. An
escaped text therefore contains no ``<|``, and removing one backslash restores it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sessionlake.llm.common import ship_code

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_RAW, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PLACE = re.compile(r"<\|(image|audio|document)_(\d+)\|>")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)

ATTACHMENT = "struct<ordinal:bigint,turn_index:bigint,part_index:bigint,kind:string,ref:string,n_tokens:bigint,offset:bigint>"
SPAN = "struct<begin:bigint,end:bigint>"


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass
class Costs:
    """Expanded tokens of attachments: image tiles, audio seconds, document pages."""

    tile: int = 512
    tokens_per_tile: int = 256
    tokens_per_second: int = 25
    tokens_per_page: int = 768


@dataclass
class PartVisitor:
    """Flattens the parts of one conversation, in order, into template text."""

    costs: Costs = field(default_factory=Costs)
    attachments: list[dict] = field(default_factory=list)
    turn: int = 0
    part: int = 0
    length: int = 0

    def visit(self, part: dict) -> str:
        kind = part.get("type")
        method = getattr(self, f"visit_{kind}", None) if kind in ("text", "image", "audio", "document") else None
        return (method or self.visit_text)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        w, h = max(part.get("width") or 1, 1), max(part.get("height") or 1, 1)
        tiles = math.ceil(w / self.costs.tile) * math.ceil(h / self.costs.tile)
        return self._place("image", part, tiles * self.costs.tokens_per_tile)

    def visit_audio(self, part: dict) -> str:
        return self._place("audio", part, math.ceil(max(part.get("seconds") or 0, 0) * self.costs.tokens_per_second))

    def visit_document(self, part: dict) -> str:
        return self._place("document", part, max(part.get("pages") or 1, 1) * self.costs.tokens_per_page)

    def _place(self, kind: str, part: dict, tokens: int) -> str:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "turn_index": self.turn, "part_index": self.part, "kind": kind, "ref": part.get("ref"), "n_tokens": int(tokens), "offset": self.length})
        return f"<|{kind}_{ordinal}|>"


def format_turns(turns: list[dict], loss_roles: frozenset[str], costs: Costs) -> dict:
    """One conversation's template text, loss spans (code points), attachments and tokens."""
    visitor, out, spans, at = PartVisitor(costs), [], [], 0
    for i, turn in enumerate(turns):
        role = turn["role"] or ""
        head = f"{START}{escape(role).replace(chr(10), NEWLINE)}\n"
        visitor.turn, body = i, []
        at += len(head)
        begin = at
        for j, part in enumerate(turn["parts"] or []):
            visitor.part, visitor.length = j, at
            body.append(visitor.visit(part))
            at += len(body[-1])
        if role in loss_roles:
            spans.append({"begin": begin, "end": at})
        out += [head, *body, END, "\n"]
        at += len(END) + 1
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": visitor.attachments, "expanded_tokens": sum(a["n_tokens"] for a in visitor.attachments), "n_turns": len(turns)}


def parse_parts(formatted: str, attachments: list[dict] = ()) -> list[tuple[str, list[dict]]]:
    """The (role, parts) turns of a formatted conversation, typed as they were: text parts, and of a placeholder its type, ordinal and, if attachments are given, ref.

    Escaped text holds no control string, so whatever reads as a placeholder is one. Text parts side by side come back as one, empty ones not at all.
    """
    refs = {a["ordinal"]: a["ref"] for a in attachments}
    turns = []
    for role, body in _TURN.findall(formatted):
        parts, at = [], 0
        for m in [*_PLACE.finditer(body), None]:
            text = body[at : m.start() if m else len(body)]
            if text:
                parts.append({"type": "text", "text": unescape(text)})
            if m:
                parts.append({"type": m[1], "ordinal": int(m[2])} | ({"ref": refs[int(m[2])]} if int(m[2]) in refs else {}))
                at = m.end()
        turns.append((unescape(role.replace(NEWLINE, "\n")), parts))
    return turns


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; attachments have no text, parse_parts tells where they are."""
    return [(role, "".join(p.get("text", "") for p in parts)) for role, parts in parse_parts(formatted)]


def loss_text(formatted: str, spans: list[dict]) -> str:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)


def json_parts(text: str | None) -> list[dict]:
    """Parts of a content value: a JSON array of typed parts, or else one plain text part."""
    if text and text.lstrip()[:1] == "[":
        try:
            value = json.loads(text)
        except ValueError:
            value = None
        if isinstance(value, list) and value and all(isinstance(p, dict) and p.get("type") in ("text", "image", "audio", "document") for p in value):
            return value
    return [{"type": "text", "text": text or ""}]


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", typed: bool = False, loss_roles: tuple[str, ...] = ("assistant",), costs: Costs | None = None) -> DataFrame:
    """One row for each conversation: its key, template text, loss spans, attachments.

    content: an array of typed parts (structs with type and text, ref, width, height, seconds or
    pages), or a string column: every string is plain text, whatever it looks like; only with typed, which
    is for strings that are trusted, a JSON array of typed parts is flattened part by part. Turns go in order of turn, then role, then
    content, nulls first; repeated rows are repeated turns. Null role or content is the
    empty string; null conv_id is a conversation of its own; a part that lacks a field
    counts as empty; an unknown part type counts as text. An empty table gives no rows.
    Other columns of messages are ignored. A conversation is one output string, so its
    rows meet in one task; nothing else does.
    """
    ship_code(messages.sparkSession)
    costs, roles, key = costs or Costs(), frozenset(loss_roles), messages.schema[conv].dataType
    listed = isinstance(messages.schema[content].dataType, ArrayType)

    def parts_of(value: str | list[dict] | None) -> list[dict]:
        if listed:
            return [p or {} for p in value or ()]
        return json_parts(value) if typed else [{"type": "text", "text": value}]

    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(content).alias("c"))))
    grouped = messages.groupBy(F.col(conv).alias("conv_id")).agg(turns.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(k, pa.string() if k in ("kind", "ref") else pa.int64()) for k in ("ordinal", "turn_index", "part_index", "kind", "ref", "n_tokens", "offset")])
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                rows = [format_turns([{"role": t["r"], "parts": parts_of(t["c"])} for t in turns], roles, costs) for turns in some.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("conv_id"), pa.array([r["n_turns"] for r in rows], pa.int64()), pa.array([r["formatted"] for r in rows], pa.string()), pa.array([r["loss_spans"] for r in rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([r["attachments"] for r in rows], pa.list_(kind)), pa.array([r["expanded_tokens"] for r in rows], pa.int64())],
                    names=["conv_id", "n_turns", "formatted", "loss_spans", "attachments", "expanded_tokens"],
                )

    return grouped.mapInArrow(run, f"conv_id {key.simpleString()}, n_turns bigint, formatted string, loss_spans array<{SPAN}>, attachments array<{ATTACHMENT}>, expanded_tokens bigint")
