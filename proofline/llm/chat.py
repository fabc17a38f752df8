"""Prefix-target expansion of conversations, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, and
only its own text trainable.  A turn is written as

    <s>[INST]role[/INST]text</s>

and the four control strings inside roles and texts get a backslash behind their
first character (one more if some are there), which ``unescape`` takes off again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def expand_prefix_targets(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    target_role: str = "assistant", keep_rest: bool = True,
) -> DataFrame:
    """One row per assistant turn: the formatted prefix with the reply as its only trainable span.

    Returns ``conversation`` (its column name kept), ``target_turn`` (null for the rest), ``position`` (of
    the last turn inside, from 1), ``formatted``, ``loss_start`` and ``loss_length`` (code points in
    ``formatted``, the escaped reply without its end mark) and ``is_last``.  With ``keep_rest`` a
    conversation that does not end with an assistant turn gives one more example that holds all
    of it and trains nothing, so that no turn is lost.

    Null texts and roles count as empty.  Turns are ordered by ``turn`` (null first), then role and text, so
    repeated rows are kept, side by side.  Rows with a null conversation form a conversation.  An empty table gives none.
    Other columns, whatever their names, are left behind.  A conversation is one row here, as its longest
    example is; examples are built one at a time after the expansion, so memory follows the conversation, not its square.
    """
    c = turns.select(
        F.col(conversation).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    told = c.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    pieces = F.transform("rows", lambda r: F.concat(F.lit(OPEN), escape(r["role"]), F.lit(MIDDLE), escape(r["text"]), F.lit(CLOSE)))
    wanted = F.filter(
        F.sequence(F.lit(1), F.size("rows")),
        lambda i: (F.element_at("rows", i)["role"] == target_role) | (F.lit(keep_rest) & (i == F.size("rows"))),
    )
    each = told.select("conv", "rows", pieces.alias("pieces"), F.array_max(wanted).alias("final"), F.explode(wanted).alias("position"))
    last = F.element_at("rows", F.col("position"))
    trained = last["role"] == target_role
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("position")), "")
    return each.select(
        F.col("conv").alias(conversation),
        F.when(trained, last["turn"]).alias("target_turn"),
        "position",
        formatted.alias("formatted"),
        F.when(trained, F.length(formatted) - F.length(escape(last["text"])) - len(CLOSE)).alias("loss_start"),
        F.when(trained, F.length(escape(last["text"]))).otherwise(0).alias("loss_length"),
        (F.col("position") == F.col("final")).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text again: an array of (role, text)."""
    marked = F.split(formatted, CLOSE, -1)
    return F.transform(
        F.slice(marked, F.lit(1), F.size(marked) - 1),
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substr(x, F.locate(MIDDLE, x) + len(MIDDLE))).alias("text"),
        ),
    )


def read_conversations(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation what its examples hold, read from the formatted texts alone.

    Every turn comes from the last example, every trained text from the span of its own one.
    """
    trained = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    told = F.array_join(
        F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "",
    )
    each = examples.select(
        conversation,
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), F.struct("position", trained.alias("text"))).alias("loss"),
        F.when(F.col("is_last"), F.struct(
            (F.size(F.split("formatted", CLOSE, -1)) - 1).cast("long").alias("n"), F.sha2(told, 256).alias("digest"),
        )).alias("all"),
    )
    loss = F.array_join(F.transform(F.sort_array("losses"), lambda x: x["text"]), "")
    return (
        each.groupBy(conversation)
        .agg(
            F.max("all").alias("all"), F.collect_list("loss").alias("losses"), F.sum("chars").alias("formatted_chars"),
            F.count("*").alias("n_examples"),
        )
        .select(
            conversation, F.col("all.n").alias("n_turns"), F.col("all.digest").alias("turns_sha256"),
            F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples",
        )
    )
