from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalith.llm.chat_formatting import decode_role, encode_role, escape, format_chats, read_back, unescape

MESSAGES = "conv_id long, turn long, role string, text string"
NASTY = ["<|end|>\n", "<|turn|>", "<|body|>", "</s>", "[INST]", "[/INST]", "<s>", "\\", "<\\|", "[\\\\INST]", "$1", "%0A", "%", "<", "|", "\n", "é😀", "text", "<|image|>"]


def back(spark, rows, **kw):
    df = spark.createDataFrame(rows, MESSAGES)
    return {r.conv_id: r for r in read_back(format_chats(df, **kw)).collect()}


def plain(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


nasty = st.lists(st.sampled_from(NASTY), max_size=6).map("".join)
rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(-3, 5)), st.one_of(st.none(), st.sampled_from(["user", "assistant", "system"]), nasty), st.one_of(st.none(), nasty)), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, st.integers(1, 4))
def test_round_trip(spark, messages, chunk):
    got = back(spark, messages, chunk=chunk)
    want = plain(messages)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns and got[c].n_turns == len(turns)
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")


def test_escapes(spark):
    texts = NASTY + [a + b for a in NASTY for b in NASTY] + ["<\\\\\\|x", "[\\/INST]", "</s></s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), encode_role(F.col("t")).alias("r"))
    for r in df.select("*", unescape(F.col("e")).alias("u"), decode_role(F.col("r")).alias("d")).collect():
        assert r.u == r.t == r.d
        assert not any(x in r.e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]")) and "\n" not in r.r and "<" not in r.r


def test_long_conversation(spark):
    messages = [(1, k, "assistant" if k % 2 else "user", f"turn {k} </s>") for k in range(3000)]
    got = back(spark, messages)[1]
    assert [t.text for t in got.turns] == [m[3] for m in messages]
    assert got.loss_text == "".join(m[3] for m in messages if m[1] % 2)


def test_parts(spark):
    parts = [{"type": "text", "text": "look <|"}, {"type": "image", "ref": "a.png", "width": 700, "height": 336}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": None, "text": None}]
    df = spark.createDataFrame([(1, 0, "user", None, json.dumps(parts)), (1, 1, "assistant", "two words", None)], MESSAGES + ", j string")
    df = df.withColumn("parts", F.from_json("j", "array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"))
    r = format_chats(df).first()
    assert "<|text|>look <\\|<|image:0000000001|><|audio:0000000002|><|document:0000000003|><|text|><|end|>" in r.formatted
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 432), (2, "audio", "b.wav", 50), (3, "document", "c.pdf", 1800)]
    assert (r.expanded_tokens, r.n_words) == (432 + 50 + 1800, 3 + 2)
    turns = read_back(format_chats(df)).first().turns
    assert [tuple(p) for p in turns[0].parts] == [("text", "look <|", None, None), ("image", None, 1, "a.png"), ("audio", None, 2, "b.wav"), ("document", None, 3, "c.pdf"), ("text", "", None, None)]


piece = st.one_of(nasty.map(lambda t: ("text", t, None)), st.tuples(st.sampled_from(["image", "audio", "document"]), st.none(), st.sampled_from(["r1", "<|text|>", None])))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.lists(piece, min_size=1, max_size=5)), min_size=1, max_size=8), st.integers(1, 3))
def test_parts_round_trip(spark, turns, chunk):
    """Texts whose ends make a control string together, placeholders spelt out in texts, empty texts: all parts come back, numbered through the conversation."""
    rows = [(7, k, role, None, [(kind, text, ref, None, None, None, None) for kind, text, ref in parts]) for k, (role, parts) in enumerate(turns)]
    df = spark.createDataFrame(rows, MESSAGES + ", parts array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>")
    got = read_back(format_chats(df, chunk)).first()
    n, want = 0, []
    for _, parts in turns:
        own = []
        for kind, text, ref in parts:
            n += kind != "text"
            own.append((kind, text, None, None) if kind == "text" else (kind, None, n, ref))
        want.append(own)
    assert [[tuple(p) for p in t.parts] for t in got.turns] == want
    assert [(a.number, a.type, a.ref) for a in got.attachments] == [(p[2], p[0], p[3]) for own in want for p in own if p[2]]
    assert got.loss_text == "".join(p[1] for (role, _), own in zip(turns, want, strict=True) if role == "assistant" for p in own if p[0] == "text")


def test_parts_that_meet(spark):
    """Neither two texts nor a text and a mark make a control string where they meet."""
    for a, b in (("x<", "|image:0000000000|>"), ("[", "INST]"), ("<", "/s>"), ("<", "|end|>\n")):
        rows = [(1, 0, "user", None, [("text", a, *[None] * 5), ("text", b, *[None] * 5)])]
        df = spark.createDataFrame(rows, MESSAGES + ", parts array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>")
        got = read_back(format_chats(df)).first()
        assert [p.text for p in got.turns[0].parts] == [a, b] and got.n_turns == 1 and not got.attachments


def test_clashing_columns_empty_and_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], MESSAGES).selectExpr("*", "1 AS c", "2 AS t", "3 AS v", "4 AS ts", "5 AS n_turns")
    assert format_chats(df).first().n_turns == 1
    assert format_chats(df.filter("false")).count() == 0
    plan = read_back(format_chats(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
