"""Chat formatting with typed content parts, reversibly escaped, with a loss mask. DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. A visitor goes through them in order: text is escaped,
every other part becomes a numbered placeholder and an attachment with its reference and the tokens it will expand to. Each turn
is written between control strings; control strings inside texts are broken by an escape that reading back takes out again. The
same escape stands between a part and a text part after it, so that no control string can come about across their border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that no escaped text contains: those of this template and those of common others.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: kind: (tokens of each, tokens of each unit: image tile, second of audio, page of a document)
EXPANSION = {"image": (85, 170), "audio": (2, 25), "document": (8, 600)}
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    """A backslash becomes ``\\b``; a control string gets ``\\e`` after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\e{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\l"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\l"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _known(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("")).isin(*EXPANSION)


def _tokens(part: Column) -> Column:
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    out = F.lit(0)
    for kind, (base, each) in EXPANSION.items():
        out = F.when(part["kind"] == kind, base + each * units).otherwise(out)
    return out.cast("long")


def _visit(parts: Column, before: Column) -> Column:
    """Content string of a turn: before attachments come first in its conversation."""
    start = F.struct(F.lit("").alias("out"), before.cast("long").alias("n"))

    def step(acc: Column, part: Column) -> Column:
        n = acc["n"] + F.when(_known(part), 1).otherwise(0)
        mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), n.cast("string"), F.lit("|>"))
        border = F.when(acc["out"] == "", "").otherwise("\\e")
        piece = F.when(_known(part), mark).otherwise(F.concat(border, escape(F.coalesce(part["text"], F.lit("")))))
        return F.struct(F.concat(acc["out"], piece).alias("out"), n.alias("n"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv, formatted, loss_spans, attachments, expanded_tokens``: one row per conversation.

    parts is a column of type PARTS; without it text_col is the only part. Unknown kinds and null elements count as text, null
    text and null role as empty, null parts as no part, negative units as none. Texts of any length are formatted whole. Turns go by turn, then role, then content: rows that tie in all are equal. Null
    conversation ids make one conversation. loss_spans are (start, end) in code points of the content of loss_role's turns.
    One conversation is one value, so its rows meet in a task; nothing there grows faster than their length. An empty table
    gives an empty result; other columns are not read.
    """
    content = text_parts(F.col(text_col).cast("string")) if parts is None else parts
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(content, F.array().cast(PARTS)).alias("parts")
    )
    rows = rows.withColumn("files", F.filter("parts", _known))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("seen", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))).withColumn("body", _visit(F.col("parts"), F.col("seen")))
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + len(END))
    rows = rows.withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.length("head"))
    files = F.transform(F.col("files"), lambda p, i: F.struct((F.col("seen") + i + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    turns = rows.select("conv", F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"), files.alias("files")).alias("t"))
    convs = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: t["files"]))
    return convs.select(
        "conv",
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with ``turns`` (role and text of each, placeholders left in the text) and ``loss_texts``, parsed from the string."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(head) + 2, F.length(x) - F.length(head) - 1 - len(END))
        return F.struct(_unescape_role(head).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_texts": loss})
