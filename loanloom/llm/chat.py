"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only the reply is under the loss mask. A conversation is one training
sequence, so its turns meet in one row; its examples are prefixes of one rendering.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a text
is told apart by a backslash: ``<``, any backslashes and ``|`` gain one backslash, and
reading back takes it off, so no text can open or close a turn.

Rows are ordered by turn, then role, then text, missing values first, so ties and
repeated rows have one order and each stays a turn. Missing texts and roles are
empty. Rows without a conversation id are one conversation. A conversation that
does not end with a reply has one more example with no loss, which holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Also keeps line breaks out of a role, which ends at one."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, text, trainable, loss_start, loss_end``: one row per reply.

    ``loss_start`` and ``loss_end`` are code points of ``text``; NULL for the
    closing example of a conversation that ends without a reply.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    content = escape(F.coalesce(F.col("text"), F.lit("")))
    turns = (
        conversations.select(
            "conv_id", "turn", "role", "text",
            F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"), content, F.lit(END)).alias("piece"),
            F.length(content).alias("content_chars"),
            F.coalesce(F.col("role") == REPLY, F.lit(False)).alias("is_reply"),
        )
        .withColumn("place", F.row_number().over(order))
        .withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece", "end", "content_chars", "is_reply"))).alias("turns")
    )
    targets = F.filter("turns", lambda t: t["is_reply"] | (t["place"] == F.size("turns")))
    rendered = whole.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("rendering"),
        F.transform(targets, lambda t: F.struct(t["end"].alias("end"), t["content_chars"].alias("content_chars"), t["is_reply"].alias("is_reply"))).alias("targets"),
    )
    examples = rendered.select("conv_id", "rendering", F.posexplode("targets").alias("example", "target"))
    stop = (F.col("target.end") - len(END)).cast("int")
    reply = F.col("target.is_reply")
    return examples.select(
        "conv_id",
        "example",
        F.substring("rendering", F.lit(1), F.col("target.end").cast("int")).alias("text"),
        reply.alias("trainable"),
        F.when(reply, stop - F.col("target.content_chars")).alias("loss_start"),
        F.when(reply, stop).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of ``role`` and ``text``."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    kept = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parts(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"),
        )

    return F.transform(kept, parts)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: turns, trained text and characters."""
    trained = F.when(
        F.col("trainable"),
        unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))),
    )
    held = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", trained.alias("reply"))))).alias("replies"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.col("replies.reply"), "")
    turns = read_turns(F.col("longest"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return held.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
