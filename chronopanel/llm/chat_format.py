"""Chat formatting with typed content parts, in DataFrame functions alone.

A visitor flattens each message's parts in order: text is escaped and put in; an image, audio or document part becomes a
numbered placeholder, its reference and expanded token count go to the attachment list. Turns are put between marks:

    <|im_start|>role<|im_sep|>content<|im_end|>\\n

Escaping: each backslash, "<" and "[" of a role or text is followed by a backslash, so that no control string (all
start with one of the two brackets) is left in a text, not even across parts; unescaping drops that backslash. The loss
mask is a list of spans, in code points of the formatted text, over the contents of the roles that are learned.

Cases: null text is empty; a null role is written as an empty one and never learned; an unknown part type becomes a
placeholder without tokens; turns with equal numbers go by role and text; repeated rows stay; rows with a null
conversation id are one conversation; an empty table gives no rows; other columns are not read. A conversation is one
value of the result, so its turns meet in one task, once, in one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: one for each square of an image's pixels, so many for a second of audio and for a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def text_parts(text: Column) -> Column:
    """A message of plain text as a list of one part."""
    nothing = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), *(nothing.alias(c) for c in ("ref", "width", "height", "seconds", "pages")))
    return F.array(part).cast(f"array<{PART_TYPE}>")


def expanded_tokens(part: Column) -> Column:
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    count = F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["type"] == "document", part["pages"] * PAGE_TOKENS)
    return F.coalesce(count.cast("long"), F.lit(0).cast("long"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("")) == "text"


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The content with placeholders, and the attachments (position, type, ref, tokens), from the parts of a message."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>"))
    placeholder = lambda p, i: F.concat(F.lit("<|"), F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise(F.lit("attachment")), F.lit(":"), i.cast("string"), F.lit("|>"))
    content = F.array_join(F.transform(parts, lambda p, i: F.when(_is_text(p), escape(p["text"])).otherwise(placeholder(p, i))), "")
    found = F.transform(parts, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return content, F.filter(found, lambda x: ~_is_text(x))


def format_chats(messages: DataFrame, parts: str = "parts", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (start, length), attachments (turn_index, position, type, ref, tokens), n_tokens_attached."""
    content, attachments = flatten_parts(F.col(parts))
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), content.alias("content"), attachments.alias("attached"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    rows = rows.select("conv_id", "turn", "role", "content", F.concat(head, F.col("content"), F.lit(END)).alias("said"), F.length(head).alias("head"), F.length("content").alias("body"), "attached")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", F.sum(F.length("said")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.coalesce("start", F.lit(0)) + F.col("head")
    is_learned = F.coalesce(F.col("role").isin(list(learned)), F.lit(False))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "said", F.when(is_learned, F.struct(start.alias("start"), F.col("body").alias("length"))).alias("span"), "attached"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    named = lambda t: F.transform(t["attached"], lambda a: F.struct((t["at"] - 1).alias("turn_index"), a["position"].alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    out = grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("turns", named)).alias("attachments"))
    return out.withColumn("n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as structs of role and text (placeholders stay)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")
    halves = F.transform(pieces, lambda x: F.split(F.substring(x, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, spans joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"]))), "")
