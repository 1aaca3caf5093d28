r"""Chat formatting: conversations of typed content parts as one marked string, with loss spans and attachments.

A turn is ``<|turn|>role<|says|>content<|end|>``. Inside roles and texts control strings are escaped reversibly: a
backslash is doubled, and one is put behind the first character of whatever looks like a control string of this or other
common templates (``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``[INST]``, ``[/INST]``). So ``<|`` only ever
marks, and dropping the backslash of each escaped character restores the text.

A content is a list of parts (kind, text, ref, units). A visitor takes them in order: text is escaped and copied; image,
audio and document parts become a placeholder ``<|kind:i|>``, numbered through the conversation; it records the reference
and how many tokens the placeholder stands for: units times the kind's tokens a unit.

How it scales: the work is linear in the turns and parts. Numbers of placeholders and positions of contents are running
sums of a window over each conversation, which spills; turns are put together once, after them, over the same exchange.
A conversation is one string, so its rows meet in one task, and it must fit in a row.

Defined results: null texts, roles and lists are empty; unknown kinds are treated as documents; rows of one conversation
and turn go by role and parts, repeated rows are repeated turns; a null conversation id is a conversation; an empty table
gives an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Tokens for each unit of a part: an image tile, a second of sound, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 400}
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"
_CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
_UNNUMBERED = r"(?<=<\|(?:image|audio|document):)(?=\|>)"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("int").alias("units")))


def kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", "image", "audio"), part["kind"]).otherwise(F.lit("document"))


def attached(parts: str | Column) -> Column:
    return F.filter(parts, lambda p: kind(p) != "text")


def tokens(part: Column) -> Column:
    each = F.coalesce(*[F.when(kind(part) == k, n) for k, n in UNIT_TOKENS.items()], F.lit(0))
    return F.coalesce(part["units"], F.lit(0)).cast("long") * each


def visited(parts: str) -> Column:
    """The parts in order as one text: texts escaped, placeholders without their numbers."""
    return F.array_join(F.transform(parts, lambda p: F.when(kind(p) == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":|>")))), "")


def numbered(content: Column, before: Column, count: Column) -> Column:
    """``content`` with its ``count`` placeholders numbered from ``before``; escaped texts hold no ``<|``."""
    around = F.transform(F.split(content, _UNNUMBERED), lambda x, i: F.when(i < count, F.concat(x, (before + i).cast("string"))).otherwise(x))
    return F.when(count == 0, content).otherwise(F.array_join(around, ""))


def formatted(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: Column | None = None, learn: str = "assistant") -> DataFrame:
    """A row for each conversation: conversation_id, n_turns, formatted, loss_spans (start, length in code points, from 1,
    of the contents of the role ``learn``), attachments (index, kind, ref, tokens) and attachment_tokens.

    ``content``: array of struct(kind, text, ref, units); by default one text part from column text.
    """
    content = text_part(F.col("text")) if content is None else content
    plain = rows.select(F.col(f"`{conversation}`").alias("conversation_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(content, F.array().cast(PARTS)).alias("parts"))
    counted = plain.withColumn("n_attached", F.size(attached("parts")))

    order = Window.partitionBy("conversation_id").orderBy("turn", "role", "parts")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"seq": F.row_number().over(order), "before": F.sum("n_attached").over(upto).cast("int") - F.col("n_attached")})
    turns = placed.select(
        "conversation_id", "seq", (F.col("role") == learn).alias("learn"),
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)).alias("head"),
        numbered(visited("parts"), F.col("before"), F.col("n_attached")).alias("body"),
        F.transform(attached("parts"), lambda p, i: F.struct((F.col("before") + i).alias("index"), kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"))).alias("listed"),
    )
    measured = turns.withColumn("n_head", F.length("head")).withColumn("n_body", F.length("body")).withColumn("size", F.col("n_head") + F.col("n_body") + F.lit(len(END)))
    by_seq = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = measured.withColumn("end", F.sum("size").over(by_seq))
    span = F.struct((F.col("end") - F.col("size") + F.col("n_head") + 1).cast("int").alias("start"), F.col("n_body").alias("length"))
    pieces = ends.select("conversation_id", F.struct("seq", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("learn"), span).alias("span"), "listed").alias("t"))
    chats = pieces.groupBy("conversation_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    joined = chats.select(
        "conversation_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["listed"])).alias("attachments"),
    )
    return joined.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once, however often the lambdas within ask for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def under_spans(text: str, spans: str) -> Column:
    """The stretches of a text under spans (start, length in code points), one after the other.

    Four bytes a code point let each stretch be cut without a walk from the start of the text; an ``x`` before it keeps
    the decoder from taking a first U+FEFF for a byte order mark.
    """
    mark = F.encode(F.lit("x"), "UTF-32")
    wide = lambda w: F.transform(spans, lambda s: unescaped(F.substring(F.decode(F.concat(mark, F.substring(w, s["start"] * 4 - 3, s["length"] * 4)), "UTF-32"), F.lit(2), s["length"])))
    return F.array_join(once(F.encode(F.col(text), "UTF-32"), wide), "")


def read_back(chats: DataFrame) -> DataFrame:
    """Adds to ``formatted()``'s rows what its string says: turns (role, text), and loss_text: all under the loss spans."""
    said = r"(?s)<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>"
    role, text = (F.regexp_extract_all("formatted", F.lit(said), F.lit(k)) for k in (1, 2))
    turns = F.zip_with(role, text, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))
    return chats.withColumn("turns", turns).withColumn("loss_text", under_spans("formatted", "loss_spans"))
