"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts (type, text, ref, tokens). A visitor
flattens them in order: image, audio and document parts become placeholders, and
each attachment's reference, place and expanded token count is recorded; text
parts with nothing between them are one text, which is escaped as a whole. Turns
are marked by control strings; in texts `<`, any backslashes and `|` gain one
backslash after the `<`, so no text holds a control string and taking one away
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: The control strings and the placeholder of each kind of part.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_escaped(role: Column) -> Column:
    """Roles stand on a line of their own: backslashes and line ends are escaped as well."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def role_unescaped(role: Column) -> Column:
    # \\ is kept apart as \0 while \n becomes a line end
    role = F.replace(role, F.lit("\\\\"), F.lit("\\\0"))
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\")))


def text_parts(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


#: In a body under way: a sign that no text holds, then the kind of a placeholder; the sign itself, where a text has it, gains a letter.
_SIGN, _LETTERS, _OWN = "\0", dict(zip(PLACEHOLDERS, "iad", strict=True)), "\0t"


def _visited(part: Column) -> Column:
    """A part before escaping: its text, or the sign of its kind; other kinds give nothing."""
    out = F.when(part["type"] == "text", F.replace(F.coalesce(part["text"], F.lit("")), F.lit(_SIGN), F.lit(_OWN)))
    for kind, letter in _LETTERS.items():
        out = out.when(part["type"] == kind, F.lit(_SIGN + letter))
    return out.otherwise(F.lit(""))


def _runs(parts: Column) -> Column:
    """The escaped texts before, between and after the placeholders. Neighbouring texts are escaped as one, as a control string can lie across them."""
    return F.split(escaped(F.array_join(F.transform(parts, _visited), "")), f"{_SIGN}[{''.join(_LETTERS.values())}]", -1)


def _plain(run: Column) -> Column:
    return F.replace(run, F.lit(_OWN), F.lit(_SIGN))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens: one row per conversation.

    messages: a row per turn; content: array<struct<type, text, ref, tokens>>.
    Turns stand in order of turn (nulls first), then role, then text; repeated rows
    are repeated turns. Null texts, contents and roles are empty; a part of an
    unknown type gives nothing. loss_spans: [start, end) in code points of formatted,
    one per turn of `loss_role`: its content. attachments: (turn: its place from 0,
    position: code point of the placeholder, type, ref, tokens). expanded_tokens:
    the attachments' tokens in all (null: one). Null conv_ids form one conversation.
    The turns of a conversation are sorted by the shuffle, which can spill; only the
    finished conversation is gathered in one row.
    """
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(content), F.array().cast(f"array<{PART}>")).alias("parts")
    )
    rows = rows.withColumn("runs", F.transform(_runs(F.col("parts")), _plain)).withColumn("parts", F.filter("parts", lambda p: p["type"].isin(list(PLACEHOLDERS))))
    marks = F.transform("parts", lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv]), p["type"]))
    rows = rows.withColumn("marks", marks).withColumn("body", F.array_join(F.transform("runs", lambda r, i: F.concat(r, F.coalesce(F.get("marks", i), F.lit("")))), ""))
    rows = rows.withColumn("head", F.concat(F.lit(START), role_escaped(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("n_head", F.length("head")).withColumn("n_body", F.length("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.xxhash64("parts"))
    whole = F.col("n_head") + F.col("n_body") + F.lit(len(END) + 1)
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("at", F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - whole + F.col("n_head"))
    # attachments of a turn: each placeholder stands after the texts and placeholders before it
    before = lambda i: F.aggregate(F.slice("runs", 1, i + 1), F.lit(0), lambda n, r: n + F.length(r)) + F.aggregate(F.slice("marks", 1, i), F.lit(0), lambda n, m: n + F.length(m))
    found = F.transform(
        "parts",
        lambda p, i: F.struct(F.col("place").cast("int").alias("turn"), (F.col("at") + before(i)).cast("long").alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).alias("tokens")),
    )
    rows = rows.select(
        "conv_id", "place", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n_body")).alias("end"))).alias("span"), found.alias("found")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "span", "found"))).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["found"]))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation (placeholders stay in texts)."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    at = lambda p: F.instr(p, "\n")
    return F.transform(pieces, lambda p: F.struct(role_unescaped(F.substring(p, F.lit(1), at(p) - 1)).alias("role"), unescaped(F.substring(p, at(p) + 1, F.length(p) - at(p) - F.lit(len(END) + 1))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
