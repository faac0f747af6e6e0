"""Preference formatting: chosen and rejected conversations become one prompt and two masked completions.

The longest common prefix of turns (same role and text) is rendered once, as the prompt; what is left of either conversation is
rendered as its completion, with the spans of characters (start, end) that count in training: the
texts of assistant turns and the mark that ends them. All of it is DataFrame operations: turns are
gathered per conversation, as a conversation is one training row in any case, and pairs are joined by id.

Role and text can't forge a turn: in both, "<|" is rendered as "< |", and a role's line ends as blanks.

A common prefix never takes a whole conversation's last assistant turn away from the other: if one conversation is a prefix of the other its completion is
empty, and if both are equal the pair says nothing and is marked `identical`.

Defined cases: turns are ordered by turn (null first), then role and text; repeated turns are kept; a null role or text is rendered
as empty, and equals another null only; turns without conv_id belong to no conversation and are left out;
pairs that name an unknown conversation have no turns on that side; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import with_next

#: The marks of a turn in the rendered text. Fixed values of a public chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): array<struct<turn, role, text>> in order."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda a, b: F.when(a["turn"].eqNullSafe(b["turn"]), F.when(F.struct(a["role"], a["text"]) < F.struct(b["role"], b["text"]), -1).when(F.struct(a["role"], a["text"]) > F.struct(b["role"], b["text"]), 1).otherwise(0)).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).otherwise(1)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both begin with."""
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]), F.lit(False)))
    shorter = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.slice(both, 1, F.greatest(shorter, F.lit(1))), False).cast("int")
    return F.when(shorter <= 0, F.lit(0)).when(differs == 0, shorter).otherwise(differs - 1)


def _plain(text: Column) -> Column:
    """A text (null: empty) without marks of turns."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _role(x: Column) -> Column:
    return F.translate(_plain(x["role"]), "\r\n", "  ")


def _rendered(x: Column) -> Column:
    return F.concat(F.lit(OPEN), _role(x), F.lit("\n"), _plain(x["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _rendered))


def spans(turns: Column) -> Column:
    """array<struct<start, end>>: characters of the rendered turns that count: an assistant's text and the mark that closes it."""
    empty = F.expr("cast(array() AS array<struct<start: int, end: int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        head = F.length(F.lit(OPEN)) + F.length(_role(x)) + 1
        end = acc["at"] + F.length(_rendered(x))
        own = F.array(F.struct((acc["at"] + head).alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, add, lambda acc: acc["out"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, identical from (pair_id, chosen, rejected), both arrays of turns."""
    none = F.expr("cast(array() AS array<struct<turn: bigint, role: string, text: string>>)")
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    rows = rows.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    rows = rows.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return rows.select("pair_id", "n_prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"), ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"))


def prefer(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """format_pairs of pairs (pair_id, chosen_id, rejected_id) of conversations in turns (conv_id, turn, role, text)."""
    whole = gather(turns)
    chosen = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    rejected = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return format_pairs(pairs.join(chosen, "chosen_id", "left").join(rejected, "rejected_id", "left"))


def swap_last_answer(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation against itself with its last answer taken from the next conversation.

    The next one has the next larger conv_id (the largest is followed by the smallest). The last assistant turn and what
    follows it make way for the last assistant turn of the next conversation; without one there, nothing takes its place; a conversation without
    an assistant turn is paired with itself. Of a conversation only its id and last answer travel to the one before it.
    """
    named = turns.where(F.col("conv_id").isNotNull())
    order = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    answers = named.where("role = 'assistant'").groupBy("conv_id").agg(F.max(order)["text"].alias("next_answer"), F.lit(True).alias("answered"))
    follow = with_next(named.select("conv_id").distinct(), ["conv_id"]).select(F.col("conv_id").alias("pair_id"), F.col("next.conv_id").alias("next_id"))
    told = follow.join(answers, F.col("next_id") == F.col("conv_id"), "left").select("pair_id", "next_answer", "answered")
    at = F.expr("array_max(transform(turns, (x, i) -> CASE WHEN x.role = 'assistant' THEN i END))")
    paired = gather(turns).withColumn("at", at).join(told, F.col("conv_id") == F.col("pair_id"))
    kept = F.slice("turns", F.lit(1), F.col("at"))
    swapped = F.when(F.col("at").isNull(), F.col("turns")).when(F.col("answered").isNull(), kept).otherwise(F.concat(kept, F.array(F.struct(F.element_at("turns", F.col("at") + 1)["turn"].alias("turn"), F.lit("assistant").alias("role"), F.col("next_answer").alias("text")))))
    return paired.select("pair_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))
