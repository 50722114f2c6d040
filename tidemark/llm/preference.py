"""Preference formatting: two conversations as one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; what follows on either
side is its completion. A completion's mask lists the parts to learn from, as code point ranges: what the
assistant says there, with its end mark, and nothing of other roles.

A turn is written ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break. These marks inside
a text lose their bars, so that no text can forge a turn. Null texts count as empty, a null role as ``none``. Turns
are ordered by number (null first), then role and text; repeated rows are repeated turns. Identical conversations
have empty completions; an empty or missing conversation gives an empty prompt. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the turns (role, text) of each conversation in order. A group is one conversation."""
    one = F.struct("turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.sort_array(F.collect_list(one))
    return turns.groupBy(key).agg(F.transform(whole, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    pieces = F.transform(turns, lambda t: F.concat(_head(t), _plain(t["text"]), F.lit(END + "\n")))
    return F.array_join(pieces, "")


def learned(turns: Column) -> Column:
    """Ranges ``start-end`` of a rendered completion to learn from, joined by commas."""

    def step(state, turn):
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_plain(turn["text"])) + len(END)
        own = F.concat(state["out"], F.when(state["out"] != "", ",").otherwise(""), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == ASSISTANT, own).otherwise(state["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def formatted(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(key, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of rows with two turn arrays."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select(F.col(key), F.coalesce(F.col(chosen), none).alias("c"), F.coalesce(F.col(rejected), none).alias("r"))
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = {side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))) for side in "cr"}
    return both.select(
        F.col(key), F.col("n").alias("n_prompt_turns"), rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest["c"]).alias("chosen"), rendered(rest["r"]).alias("rejected"),
        learned(rest["c"]).alias("chosen_mask"), learned(rest["r"]).alias("rejected_mask"),
    )


def with_other_replies(talks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs out of single conversations: the rejected one ends in the last reply of the conversation next to it.

    Conversations 2n and 2n + 1 lend each other their last assistant turn. Where the other has none, the
    rejected reply is empty; a conversation without a reply is paired with itself.
    """
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), ASSISTANT)
    last = F.when(F.array_contains(F.transform("turns", lambda t: t["role"]), ASSISTANT), last).cast("int")
    own = talks.withColumn("last", last)
    lent = own.where("last is not null").select(F.col(key).bitwiseXOR(F.lit(1)).alias(key), F.element_at("turns", F.col("last") + 1)["text"].alias("lent"))
    swapped = F.transform(
        "turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), F.coalesce("lent", F.lit(""))).otherwise(t["text"]).alias("text"))
    )
    return own.join(lent, key, "left").select(key, F.col("turns").alias("chosen"), swapped.alias("rejected"))
