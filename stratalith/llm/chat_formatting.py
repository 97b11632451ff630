"""Chat formatting with typed content parts, in DataFrame functions only.

A message is text, or an array ``parts`` of typed parts (type, text, ref, width, height, seconds, pages). A visitor flattens the parts in
order: an image, audio or document part becomes a placeholder ``<|image:0000000012|>`` with the attachment's number in its conversation, ten
digits wide; the attachment's reference and the tokens that its placeholder expands to are recorded. A part of any other type is text.
A message of one text part is that text; in any other, a text part begins with ``<|text|>``, so that parts can be told apart. A turn is

    <|turn|>role<|body|>parts<|end|>\n

Control strings inside texts (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first character, those that
already hold backslashes there one more; removing one restores every text exactly. In roles %, < and line feeds are percent-encoded.
The loss mask lists the spans of the assistant's texts by turn, in code points from the turn's beginning; placeholders are not in it.
read_back() parses roles, parts and the text under the mask from the formatted string, the mask and the attachments' list; a message
without parts comes back as an empty text.

Turns are formatted in chunks of ``chunk`` turn numbers and then joined, so a long conversation is dealt over tasks first; its output
is one string. Nulls: a null text is empty, a null role empty, a null turn comes first; null conversation ids are one conversation.
Rows of equal turn follow by role, then text, then parts; rows that repeat are turns of their own. No rows from an empty table. Of extra
columns only ``parts`` is read. Very long texts are one string; a message costs the square of its number of parts (not of its length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END, TEXT = "<|turn|>", "<|body|>", "<|end|>\n", "<|text|>"
NONE = "0" * 10
CONTROL = r"(\||/s>|s>|/?INST\])"
TILE, TILE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 144, 25, 600
PARTS = "array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def encode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def words(text: Column) -> Column:
    """Words, digits and marks of a text."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]"), F.lit(0))).cast("long")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for: by tiles, seconds or pages; of unknown extent: one tile, second or page."""
    tiles = F.ceil(F.greatest(F.coalesce(part["width"], F.lit(1)), F.lit(1)) / TILE) * F.ceil(F.greatest(F.coalesce(part["height"], F.lit(1)), F.lit(1)) / TILE)
    kind = part["type"]
    return (
        F.when(kind == "image", tiles * TILE_TOKENS)
        .when(kind == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_TOKENS))
        .when(kind == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def visit(parts: Column) -> Column:
    """struct(body, texts, attachments, tokens, words) of a message's parts; texts: start and end of its texts in body. Numbers are still 0: a conversation sets them."""
    one = (F.size(parts) == 1) & ~_is_attachment(F.get(parts, F.lit(0)))
    mark = F.when(one, F.lit("")).otherwise(F.lit(TEXT))
    pieces = F.transform(parts, lambda p: F.when(_is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit(f":{NONE}|>"))).otherwise(F.concat(mark, escape(F.coalesce(p["text"], F.lit(""))))))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(done: Column, piece: Column) -> Column:
        end = done["at"] + F.length(piece)
        own = F.array(F.struct((done["at"] + F.length(mark)).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(one | piece.startswith(TEXT), F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    kept = F.transform(F.filter(parts, _is_attachment), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    tokens = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + expanded_tokens(p))
    n_words = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.when(_is_attachment(p), F.lit(0)).otherwise(words(F.coalesce(p["text"], F.lit("")))))
    return F.struct(F.array_join(pieces, "").alias("body"), F.aggregate(pieces, start, place)["spans"].alias("texts"), kept.alias("attachments"), tokens.alias("tokens"), n_words.alias("words"))


def text_parts(text: Column) -> Column:
    """A plain text as one text part."""
    nothing = {"ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items())))


def format_chats(messages: DataFrame, chunk: int = 64) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (turn, start, end), attachments (number, type, ref, tokens), expanded_tokens (theirs), n_words, for each conversation.

    messages: conv_id, turn, role, text and, if wanted, parts, which replaces text where it is not null.
    """
    parts = text_parts(F.col("text"))
    if "parts" in messages.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), parts)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), visit(parts).alias("v"))
    head = F.concat(F.lit(TURN), encode_role(F.col("role")), F.lit(BODY))
    spans = F.when(F.col("role") == "assistant", F.transform("v.texts", lambda s: F.struct((F.length(head) + s["start"]).alias("start"), (F.length(head) + s["end"]).alias("end"))))
    spans = F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))
    turn = F.struct("turn", "role", "text", F.concat(head, F.col("v.body"), F.lit(END)).alias("out"), spans.alias("spans"), F.col("v.attachments").alias("attachments"), F.col("v.tokens").alias("tokens"), F.col("v.words").alias("words"))
    chunks = rows.select("conv_id", F.floor(F.col("turn") / chunk).alias("c"), turn.alias("t")).groupBy("conv_id", "c").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    total = lambda of, what: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x[what])
    chunks = chunks.select(
        "conv_id",
        F.struct(
            "c",
            F.size("ts").cast("long").alias("n"),
            F.array_join(F.transform("ts", lambda t: t["out"]), "").alias("out"),
            F.transform("ts", lambda t: t["spans"]).alias("spans"),
            F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
            total("ts", "tokens").alias("tokens"),
            total("ts", "words").alias("words"),
        ).alias("p"),
    )
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    by_turn = F.transform(F.flatten(F.transform("ps", lambda p: p["spans"])), lambda ss, i: F.transform(ss, lambda s: F.struct(i.alias("turn"), s["start"].alias("start"), s["end"].alias("end"))))
    attachments = F.transform(F.flatten(F.transform("ps", lambda p: p["attachments"])), lambda a, i: F.struct((i + 1).alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    joined = whole.select(
        "conv_id",
        total("ps", "n").alias("n_turns"),
        F.array_join(F.transform("ps", lambda p: p["out"]), "").alias("out"),
        F.flatten(by_turn).alias("loss_spans"),
        attachments.alias("attachments"),
        total("ps", "tokens").alias("expanded_tokens"),
        total("ps", "words").alias("n_words"),
    )
    # escaped texts hold no placeholder: between two of them stands what belongs there, and the k-th is the k-th attachment's
    between = F.split("out", rf"<\|(?:image|audio|document):{NONE}\|>", -1)
    numbered = F.transform(between, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("<|"), F.get(F.col("attachments"), i - 1)["type"], F.lit(":"), F.lpad(i.cast("string"), 10, "0"), F.lit("|>"), s)))
    formatted = F.when(F.size("attachments") == 0, F.col("out")).otherwise(F.array_join(numbered, ""))
    return joined.select("conv_id", "n_turns", formatted.alias("formatted"), "loss_spans", "attachments", "expanded_tokens", "n_words")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text: its texts joined, parts: type, text, number, ref) and loss_text, parsed from formatted, loss_spans and attachments alone."""
    marks = F.split("formatted", r"<\|end\|>\n", -1)
    pieces = formatted.select("*", F.slice(marks, F.lit(1), F.size(marks) - 1).alias("_turns"))

    def part(x: Column) -> Column:
        number = F.nullif(F.regexp_extract(x, r"^<\|[a-z]+:([0-9]{10})\|>", 1), F.lit("")).cast("long")
        kind = F.when(x.startswith("<|"), F.regexp_extract(x, r"^<\|([a-z]+)", 1)).otherwise(F.lit("text"))
        text = F.when(number.isNull(), unescape(F.when(x.startswith(TEXT), F.substr(x, F.lit(len(TEXT) + 1))).otherwise(x)))
        ref = F.when(number.isNotNull(), F.get(F.col("attachments"), (number - 1).cast("int"))["ref"])
        return F.struct(kind.alias("type"), text.alias("text"), number.alias("number"), ref.alias("ref"))

    def turn(x: Column) -> Column:
        cut = F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|body\|>", 2)
        return F.struct(decode_role(F.get(cut, F.lit(0))).alias("role"), F.transform(F.split(F.get(cut, F.lit(1)), r"(?=<\|)", -1), part).alias("parts"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("_turns"), s["turn"]), s["start"] + 1, s["end"] - s["start"]))), "")
    parsed = pieces.withColumn("_parsed", F.transform("_turns", turn))
    turns = F.transform("_parsed", lambda t: F.struct(t["role"].alias("role"), F.array_join(F.transform(t["parts"], lambda p: p["text"]), "").alias("text"), t["parts"].alias("parts")))
    return parsed.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "n_turns", F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "attachments", "expanded_tokens", "n_words")
