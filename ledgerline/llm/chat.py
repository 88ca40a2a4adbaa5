"""Chat formatting in DataFrame functions only.

A turn is a list of typed content parts. One visitor (a CASE over the part's kind) flattens text, image, audio and
document parts, in order, into text and placeholders; each attachment's reference is recorded with its place and the
number of tokens its placeholder will expand to.

Template: each turn is  <|im_start|>role\\ntext<|im_end|>\\n . Control strings inside texts are made harmless
reversibly: a run of backslashes between < and | gets one more, so no text holds "<|", and reading takes one away.
In roles %, line feeds and "<|" are written %25, %0A and %3C|.

The loss mask is a list of byte ranges of the formatted text (UTF-8), one for each turn of the trained role.

Defined results: a null text is an empty text, a null role an empty role; turns are in ascending order of turn (null
first), ties in the order of role and text (of its parts, joined; then as formatted), repeated rows stay repeated; a null conversation id is a conversation of its
own; unknown kinds of parts are treated as documents; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"

#: kind: text, image (size: width, height), audio (size: seconds), document (size: pages).
PARTS = "array<struct<kind:string,text:string,ref:string,size:array<double>>>"


@dataclass(frozen=True)
class Template:
    trained: str = "assistant"
    #: Tokens: an image has one for each patch of so many pixels square, audio so many a second, a document so many a page.
    patch: int = 28
    audio_rate: float = 12.5
    page_tokens: int = 600


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    for raw, safe in (("%", "%25"), ("\n", "%0A"), ("<|", "%3C|")):
        role = F.replace(role, F.lit(raw), F.lit(safe))
    return role


def unescaped_role(role: Column) -> Column:
    for raw, safe in (("<|", "%3C|"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(safe), F.lit(raw))
    return role


def part_tokens(part: Column, t: Template) -> Column:
    """How many tokens an attachment's placeholder expands to; null sizes count as nothing."""
    a, b = F.coalesce(F.get(part["size"], F.lit(0)), F.lit(0.0)), F.coalesce(F.get(part["size"], F.lit(1)), F.lit(0.0))
    image = F.ceil(a / t.patch) * F.ceil(b / t.patch)
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", F.ceil(a * t.audio_rate)).otherwise(F.ceil(a) * t.page_tokens).cast("long")


def visited(parts: Column) -> Column:
    """A turn's parts as formatted text: escaped text and the placeholders of their kinds. Text parts that stand side by
    side are escaped as one string, so that no control string comes about where two of them meet."""

    def visit(state: Column, part: Column) -> Column:
        name = F.when(part["kind"].isin("image", "audio"), part["kind"]).otherwise(F.lit("document"))
        more = F.concat(state["open"], F.coalesce(part["text"], F.lit("")))
        closed = F.concat(state["done"], escaped(state["open"]), F.lit("<|"), name, F.lit("|>"))
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        return F.struct(F.when(is_text, state["done"]).otherwise(closed).alias("done"), F.when(is_text, more).otherwise(F.lit("")).alias("open"))

    return F.aggregate(parts, F.struct(F.lit("").alias("done"), F.lit("").alias("open")), visit, lambda s: F.concat(s["done"], escaped(s["open"])))


def format_conversations(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """conv_id, formatted, loss (array of byte ranges), attachments (kind, ref, turn place, part place, tokens).

    Lengths before each turn come from a window, so no step goes over a conversation's text again and again. A
    conversation is one row of the result, as long as it is; conversations are dealt out by their id.
    """
    t = template or Template()
    one = F.array(F.struct(F.lit("text").alias("kind"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("array<double>").alias("size")))
    content = one if parts is None else F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS))
    d = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    d = d.withColumn("body", visited(F.col("parts")))
    d = d.withColumn("head", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")))
    d = d.withColumn("segment", F.concat("head", "body", F.lit(END)))
    d = d.withColumn("plain", F.concat_ws("", F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "plain", "body")
    d = d.withColumn("place", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum(F.octet_length("segment").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    start = F.col("before") + F.octet_length("head")
    d = d.withColumn("range", F.when(F.col("role") == t.trained, F.struct(start.alias("start"), (start + F.octet_length("body")).alias("end"))))
    pieces = F.transform("parts", lambda p, i: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (F.col("place") - 1).alias("turn_place"), i.alias("part_place"), part_tokens(p, t).alias("tokens")))
    d = d.withColumn("attached", F.filter(pieces, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"))
    all_ = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment", "range", "attached"))).alias("s"))
    return all_.select(
        "conv_id", F.concat_ws("", F.transform("s", lambda x: x["segment"])).alias("formatted"),
        F.filter(F.transform("s", lambda x: x["range"]), lambda x: x.isNotNull()).alias("loss"), F.flatten(F.transform("s", lambda x: x["attached"])).alias("attachments"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text: from the formatted text and its mask alone. Placeholders of
    attachments stay in the texts."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END))
    turns = F.transform(pieces, lambda x: F.struct(unescaped_role(role(x)).alias("role"), unescaped(body(x)).alias("text")))
    data = formatted.withColumn("bytes", F.col("formatted").cast("binary"))
    masked = F.transform("loss", lambda x: unescaped(F.substring(F.col("bytes"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).cast("string")))
    return data.select("conv_id", turns.alias("turns"), F.concat_ws("", masked).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    d = read_turns(formatted)
    turns = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
