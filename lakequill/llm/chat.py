"""Chat formatting: every assistant turn becomes an example with all earlier turns as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Add a backslash inside every ``<``, backslashes, ``|``; no ``<|`` is left, and :func:`unescape` takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text), by DataFrame functions only.

    Returns conv_id, example (1, 2, ... by turn), text (all turns up to the
    trained one), loss_start and loss_end (code points of the trainable reply in
    text; equal where nothing is trained) and is_last (the example holds the
    whole conversation).  A conversation that doesn't end with an assistant turn
    has one more example, of all its turns, with nothing to train.

    Null role or text: empty.  Null turn: first.  Null conv_id: one conversation
    of its own.  Rows with the same turn: by role, then text; repeated rows are
    turns of their own.  No rows: no examples.  Other columns are ignored.
    The last example holds the whole conversation, so a conversation's turns do
    meet in one row; conversations are never gathered with each other.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("trained"), head(t).alias("head"), escape(t["text"]).alias("body")))
    parted = grouped.select("conv_id", parts.alias("parts"))
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["trained"] | (i == n))
    each = parted.select("conv_id", "parts", n.alias("n"), F.posexplode(ends).alias("example", "i"))
    before = F.array_join(F.transform(F.slice("parts", 1, F.col("i") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    last = F.element_at("parts", F.col("i"))
    built = each.select("conv_id", "n", "i", "example", F.concat(before, last["head"]).alias("prompt"), last["body"].alias("body"), last["trained"].alias("trained"))
    start = F.length("prompt")
    return built.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.concat("prompt", "body", F.lit(END)).alias("text"),
        start.alias("loss_start"),
        F.when(F.col("trained"), start + F.length("body")).otherwise(start).alias("loss_end"),
        (F.col("i") == F.col("n")).alias("is_last"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>: the inverse of the template."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digest_chats(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from their texts and loss spans."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    told = F.when(F.col("is_last"), read_turns(F.col("text")))
    each = examples.select(
        "conv_id",
        F.struct("example", loss.alias("loss")).alias("part"),
        F.size(F.coalesce(told, F.array())).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(told, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        F.length("text").cast("bigint").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
