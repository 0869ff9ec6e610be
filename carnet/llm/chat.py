r"""Chat formatting: typed content parts of a turn, flattened into one training text per conversation, in SQL functions only.

A turn has a role and an ordered list of parts (``PART``): text, image, audio or document. Each kind is visited by its own rule: a text
part gives its escaped text; the others give a placeholder ``<kind:k>``, where k counts the attachments of the conversation from 0,
an entry of ``attachments`` (kind, reference, turn, expanded tokens), and their share of ``attachment_tokens``.

A turn reads ``### role: `` + parts + ``</turn>``, with a line feed between turns. Control strings inside texts are escaped with a
backslash: ``\`` as ``\\``, ``###`` as ``\###``, ``</turn>`` as ``<\/turn>``, ``<image:`` as ``<\image:`` and so on; in roles also ``:`` as ``\:``.
Dropping each backslash that stands before a character gives the text back, so :func:`parse` restores every role and text.

Defined cases: null texts and roles are empty; a null or empty list of parts is an empty turn; turns are ordered by turn number (null
last), then role, then content, so ties and repeated rows have one order; rows without a conversation id form one conversation; parts
of an unknown kind are treated as documents. A conversation is one row of the result, so it has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string, ref: string, units: double>"
#: Tokens a part of a kind expands to: a fixed share, and so many per unit (image: tiles, audio: seconds, document: pages).
EXPANSION = {"image": (85.0, 170.0), "audio": (2.0, 25.0), "document": (3.0, 500.0)}
OPEN, END, LEARNED = "### ", "</turn>", "assistant"


def escape(text: Column) -> Column:
    """Text in which no control string stands as such."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\###"))
    for word in ("/turn>", *(f"{kind}:" for kind in EXPANSION)):
        out = F.replace(out, F.lit(f"<{word}"), F.lit(f"<\\{word}"))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", *EXPANSION), part["kind"]).otherwise("document")


def _expanded(part: Column) -> Column:
    """Tokens an attachment stands for."""
    cost = F.lit(0.0)
    for kind, (fixed, unit) in EXPANSION.items():
        cost = F.when(_kind(part) == kind, fixed + unit * F.ceil(F.greatest(F.coalesce(part["units"], F.lit(0.0)), F.lit(0.0)))).otherwise(cost)
    return cost.cast("long")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``formatted`` text, ``n_turns``, ``loss_spans`` (turn, start and length in code points of each assistant content
    in the formatted text), ``attachments`` and ``attachment_tokens``. Other columns of ``turns`` are not read."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).isNull().alias("last"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # All attachments in order; a part's number is the count of attachments before it.
    files = F.flatten(F.transform("turns", lambda t, i: F.transform(F.filter(t["parts"], lambda p: _kind(p) != "text"), lambda p: F.struct(
        _kind(p).alias("kind"), p["ref"].alias("ref"), i.cast("long").alias("turn"), _expanded(p).alias("tokens")))))
    rows = rows.withColumn("attachments", files)

    def flat(t: Column, i: Column) -> Column:
        before = F.size(F.filter("attachments", lambda a: a["turn"] < i))
        return F.aggregate(t["parts"], F.struct(F.lit("").alias("s"), before.alias("k")), lambda acc, p: F.struct(
            F.concat(acc["s"], F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(":"), acc["k"].cast("string"), F.lit(">")))).alias("s"),
            (acc["k"] + F.when(_kind(p) == "text", 0).otherwise(1)).alias("k")))["s"]

    pieces = F.transform("turns", lambda t, i: F.struct(
        F.concat(F.when(i > 0, "\n").otherwise(""), F.lit(OPEN), escape_role(t["role"]), F.lit(": ")).alias("head"), flat(t, i).alias("body"),
        (t["role"] == LEARNED).alias("learned")))
    rows = rows.withColumn("pieces", pieces)
    # Start of each content: everything that stands before it, in one running sum.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn: long, start: long, length: long>>").alias("spans"), F.lit(0).cast("long").alias("i"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["head"])
        span = F.struct(acc["i"].alias("turn"), at.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))
        return F.struct((at + F.length(p["body"]) + len(END)).alias("at"), F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), (acc["i"] + 1).alias("i"))

    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("pieces", start, step)["spans"].alias("loss_spans"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("attachment_tokens"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text as structs of role and text, read back from the text alone (placeholders stay in the text)."""
    segments = F.filter(F.split(formatted, END, -1), lambda s, i: s.startswith("###") | s.startswith("\n###"))
    header = r"(?s)^\n?### ((?:[^\\:]|\\.)*+): "
    return F.transform(segments, lambda s: F.struct(unescape(F.regexp_extract(s, header, 1)).alias("role"), unescape(F.regexp_replace(s, header, "")).alias("text")))


#: Code points of a piece of a formatted text.
PIECE = 1024


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, with nothing between. The text is cut into pieces once, and each span is put together from the pieces it
    touches, so none goes back to the start of the text."""
    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        touched = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(touched, ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    learned = F.transform(F.array(pieces), lambda held: F.transform(spans, lambda s: unescape(cut(held, s["start"], s["start"] + s["length"]))))[0]
    return F.array_join(learned, "")
