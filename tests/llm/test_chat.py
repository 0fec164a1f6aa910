from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import chat, queries
from oracle import connect, same

SF = "/root/testdata/sf0.001"
TEXT = st.text(alphabet=st.sampled_from("<|\\im_endstart>\n aé"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    rows = [{"role": r, "parts": [{"type": "text", "text": t}]} for r, t in turns]
    out = chat.format_turns(rows, frozenset({"assistant", "a"}), chat.Costs())
    assert chat.parse_chat(out["formatted"]) == turns
    assert chat.loss_text(out["formatted"], out["loss_spans"]) == "".join(t for r, t in turns if r in ("assistant", "a"))


PART = st.one_of(st.tuples(st.just("text"), TEXT), st.tuples(st.sampled_from(["image", "audio", "document"]), TEXT))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, st.lists(PART, max_size=4)), max_size=4))
def test_typed_round_trip(turns):
    """Types, order and references come back; texts side by side as one."""
    rows = [{"role": r, "parts": [{"type": k, "text" if k == "text" else "ref": v} for k, v in parts]} for r, parts in turns]
    out = chat.format_turns(rows, frozenset(), chat.Costs())
    want = []
    for role, parts in turns:
        held = []
        for k, v in parts:
            if k == "text" and held and held[-1][0] == "text":
                held[-1] = ("text", held[-1][1] + v)
            elif k != "text" or v:
                held.append((k, v))
        want.append((role, held))
    assert [(r, [(p["type"], p.get("text", p.get("ref"))) for p in parts]) for r, parts in chat.parse_parts(out["formatted"], out["attachments"])] == want


def test_oracle(spark):
    same(queries.op1_chat_format(spark, SF), connect(SF), queries.OP1_SQL)


def test_parts(spark):
    parts = [{"type": "text", "text": "see <|image_0|> "}, {"type": "image", "ref": "a.png", "width": 1000, "height": 500}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "image"}]
    rows = [(1, 1, "assistant", "fine"), (1, 0, "user", json.dumps(parts)), (2, 0, None, None), (2, 0, "user", "[1]"), (None, 5, "user", "x"), (1, 1, "assistant", "fine")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chat(frame, typed=True).collect()}
    one = got[1]
    assert [(a.kind, a.ref, a.n_tokens, a.part_index) for a in one.attachments] == [("image", "a.png", 512, 1), ("audio", "b.wav", 38, 2), ("document", "c.pdf", 1536, 3), ("image", None, 256, 4)]
    assert one.expanded_tokens == 512 + 38 + 1536 + 256 and one.n_turns == 3
    assert all(one.formatted[a.offset :].startswith(f"<|{a.kind}_{a.ordinal}|>") for a in one.attachments)
    assert chat.parse_parts(one.formatted, [a.asDict() for a in one.attachments])[0] == ("user", [
        {"type": "text", "text": "see <|image_0|> "}, {"type": "image", "ordinal": 0, "ref": "a.png"}, {"type": "audio", "ordinal": 1, "ref": "b.wav"},
        {"type": "document", "ordinal": 2, "ref": "c.pdf"}, {"type": "image", "ordinal": 3, "ref": None},
    ])
    assert chat.parse_chat(one.formatted)[0] == ("user", "see <|image_0|> ")
    plain = {r.conv_id: r for r in chat.format_chat(frame).collect()}[1]
    assert not plain.attachments and chat.parse_chat(plain.formatted)[0] == ("user", json.dumps(parts))  # a text can't forge attachments
    assert chat.parse_chat(got[2].formatted) == [("", ""), ("user", "[1]")]
    assert got[None].n_turns == 1
    assert chat.format_chat(frame.limit(0)).count() == 0


def test_parts_as_columns(spark):
    """Typed parts as an array of structs give what the same parts as JSON do; long texts and empty lists too."""
    long = "<|x|> é " * 200_000
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 600), ("text", "end", None, None)]), (1, 1, "assistant", [("text", long, None, None)]), (2, 0, "user", []), (2, 1, "user", None), (3, 0, "user", [None])]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, parts array<struct<type:string,text:string,ref:string,width:bigint>>")
    got = {r.conv_id: r for r in chat.format_chat(frame, content="parts").collect()}
    texts = spark.createDataFrame([(c, t, r, json.dumps([dict(zip(("type", "text", "ref", "width"), p)) for p in parts])) for c, t, r, parts in rows[:2]], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chat(texts, typed=True).first().formatted == got[1].formatted
    assert [(a.kind, a.ref, a.n_tokens) for a in got[1].attachments] == [("image", "a.png", 512)]
    assert chat.loss_text(got[1].formatted, got[1].loss_spans) == long
    assert chat.parse_chat(got[2].formatted) == [("user", ""), ("user", "")] and chat.parse_chat(got[3].formatted) == [("user", "")]
