"""Chat formatting [native]: typed content parts flattened to one string.

A message holds typed parts (text, image, audio, document).  A visitor, one
fold over the parts, lays them out in order: every kind but text becomes its
placeholder, whose reference and expanded token count are recorded beside it,
and the text between two placeholders is escaped as one run, so that no control
string can arise where two text parts meet.  Messages are then
framed and joined per conversation:

    <s>  [INST]role[/INST]text</s>  [INST]role[/INST]text</s>  ...

Control strings inside a text get one backslash after their first character
(``</s>`` -> ``<\\/s>``); strings that already carry backslashes there get one
more, so ``unescape`` is the exact inverse and a raw control string in the
output is always the template's own.  The loss mask covers each assistant
text (not its frame) as code-point and byte spans of the output.

Defined results: null text, role or parts count as empty; rows come by
(turn, role, text), null turns first, so ties are settled by content and
repeated rows stay as repeated turns; a null conv_id is a conversation of its
own; an empty table gives no conversations; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import let

#: Control strings of the template (the frame, then one placeholder a kind).
BOS, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDER = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
_TAILS = r"/?s>|/?INST\]|IMAGE\]|AUDIO\]|DOCUMENT\]"
ESCAPE = (r"([<\[])(\\*)(" + _TAILS + ")", r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)(" + _TAILS + ")", r"$1$2$3")

#: Expansion of attachments into model tokens.
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 256

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def text_part(text: Column) -> Column:
    """An array with one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _kind(p: Column) -> Column:
    """A part's kind: unknown or null types are text if they carry text, else documents."""
    known = F.lower(p["type"])
    return (F.when(known.isin("text", *PLACEHOLDER), known)
            .when(p["text"].isNotNull() | p["type"].isNull(), F.lit("text")).otherwise(F.lit("document")))


def _tokens(p: Column) -> Column:
    """Model tokens that stand in for an attachment (one at least)."""
    def at_least_one(c: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.coalesce(c.cast("long"), F.lit(1).cast("long")))
    patches = F.ceil(p["width"] / IMAGE_PATCH) * F.ceil(p["height"] / IMAGE_PATCH)
    kind = _kind(p)
    return (F.when(kind == "image", at_least_one(patches))
            .when(kind == "audio", at_least_one(F.ceil(p["seconds"] * AUDIO_TOKENS_A_SECOND)))
            .otherwise(at_least_one(p["pages"] * TOKENS_A_PAGE)))


def visit_parts(parts: Column) -> Column:
    """The visitor: struct<body, attachments> of a message's parts, in order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))

    mark = F.create_map(*[F.lit(x) for kind in PLACEHOLDER.items() for x in kind])

    def step(so_far: Column, p: Column) -> Column:
        text = F.struct(so_far["out"].alias("out"), F.concat(so_far["run"], F.coalesce(p["text"], F.lit(""))).alias("run"))
        other = F.struct(F.concat(so_far["out"], escape(so_far["run"]), mark[_kind(p)]).alias("out"), F.lit("").alias("run"))
        return F.when(_kind(p) == "text", text).otherwise(other)

    def noted(p: Column, i: Column) -> Column:
        return F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))

    return let(parts, lambda ps: F.struct(
        F.aggregate(ps, F.struct(F.lit("").alias("out"), F.lit("").alias("run")), step,
                    lambda a: F.concat(a["out"], escape(a["run"]))).alias("body"),
        F.filter(F.transform(ps, noted), lambda a: a["kind"] != "text").alias("attachments")))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts).

    formatted: the whole string; loss_mask: array of spans (start and length in
    code points, byte_start and byte_length); attachments: array of (message,
    part, kind, ref, tokens); expanded_tokens: the attachments' sum."""
    role = F.coalesce(F.col("role"), F.lit(""))
    shaped = messages.select("conv_id", "turn", role.alias("role"), visit_parts(F.col("parts")).alias("v"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    shaped = shaped.select(
        "conv_id", "turn", "role", F.col("v.body").alias("body"), F.col("v.attachments").alias("attachments"),
        head.alias("head"), F.concat(head, F.col("v.body"), F.lit(END)).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    placed = shaped.select(
        "conv_id", F.struct(
            F.count(F.lit(1)).over(order).alias("n"),
            F.sum(F.length("piece")).over(order).alias("stop"),
            F.sum(F.octet_length("piece")).over(order).alias("byte_stop"),
            F.length("body").alias("length"), F.octet_length("body").alias("byte_length"),
            (F.col("role") == "assistant").alias("loss"), "piece", "attachments").alias("m"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))

    def span(m: Column) -> Column:
        at = len(BOS) - len(END)
        return F.struct((m["stop"] + at - m["length"]).alias("start"), m["length"].cast("long").alias("length"),
                        (m["byte_stop"] + at - m["byte_length"]).alias("byte_start"),
                        m["byte_length"].cast("long").alias("byte_length"))

    noted = F.flatten(F.transform(F.col("ms"), lambda m: F.transform(m["attachments"], lambda a: F.struct(
        (m["n"] - 1).alias("message"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id",
        F.concat(F.lit(BOS), F.array_join(F.transform("ms", lambda m: m["piece"]), "")).alias("formatted"),
        F.transform(F.filter("ms", lambda m: m["loss"]), span).alias("loss_mask"),
        noted.alias("attachments")
    ).withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    frames = F.split(F.substr(formatted, F.lit(len(BOS) + 1)), END)

    def turn(t: Column) -> Column:
        cut = F.instr(t, CLOSE)
        return F.struct(unescape(F.substr(t, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))).alias("role"),
                        unescape(F.substr(t, cut + len(CLOSE))).alias("text"))
    return let(frames, lambda fs: F.transform(F.slice(fs, F.lit(1), F.size(fs) - 1), turn))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order (cut by byte spans, so the
    cost is proportional to the text even for conversations of many turns)."""
    return let(F.encode(formatted, "UTF-8"), lambda raw: F.transform(mask, lambda m: unescape(F.decode(
        F.substr(raw, (m["byte_start"] + 1).cast("int"), m["byte_length"].cast("int")), "UTF-8"))))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests read back from the output of ``format_conversations``."""
    turns = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        parse_formatted(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"),
        F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "n_attachments", "expanded_tokens")
