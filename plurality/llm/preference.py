"""Preference formatting: one prompt from the longest common turn prefix, and paired masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_prefix

_RENDER = "concat('<|', t.role, '|>\\n', t.text, '<|end|>\\n')"


def conversations(turns: DataFrame) -> DataFrame:
    """Columns ``conv_id, turns``: the distinct turns (role, text) of each conversation in order of (turn, role, text).

    A null role or text is empty, a null turn comes first, rows without ``conv_id`` belong to no conversation.
    """
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    return ordered.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.text as text))").alias("turns"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs ``pair_id, chosen, rejected`` (arrays of turns) derived from plain conversations, one per conversation.

    Chosen is the conversation as it is. Rejected has its last assistant turn replaced by that of
    the next conversation that has one, in order of ids; the last takes that of the first. Turns
    after the reply stay on both sides. A conversation without an assistant turn, or the only one with
    one, is its own rejected side.
    """
    rows = conversations(turns)
    rows = rows.withColumn("at", F.expr("size(turns) - array_position(reverse(transform(turns, t -> t.role = 'assistant')), true)"))
    rows = rows.withColumn("at", F.expr("if(at < size(turns), at, null)"))
    # next by order: positions come from a range partitioning, so the ids are never sorted in one task
    replies = ordered_prefix(rows.where("at is not null").select("conv_id", F.expr("turns[at].text").alias("reply")), [], ["conv_id"])
    other = replies.select((F.pmod(F.col("rank") - 2, F.col("n_total")) + 1).alias("rank"), F.col("reply").alias("other"))
    swap = replies.select("conv_id", "rank").join(other, "rank").select("conv_id", "other")
    rejected = "transform(turns, (t, i) -> if(i = at and other is not null, struct(t.role as role, other as text), t))"
    return rows.join(swap, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.expr(rejected).alias("rejected"))


def preference_rows(pairs: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per pair of ``pairs(pair_id, chosen, rejected)``: prompt, completions and their masks.

    Columns ``pair_id, n_prompt_turns, prompt, chosen, rejected`` (rendered text) and
    ``chosen_mask, rejected_mask``: for each side the character ranges ``start:end`` of its
    completion that are learnt (the content of ``learn_role`` turns with their end mark),
    comma-joined; all else is masked. The prompt is the longest common prefix of turns,
    equal in role and text, and rendered once.

    Both sides are arrays of (role, text) without nulls; the first difference is found in the row,
    so nothing is shuffled. Equal sides give empty completions and masks, an empty side an empty
    completion; empty texts render as empty turns; repeated rows repeat; other columns are not
    read. A pair is one row, as its prompt is one string.
    """
    same = "zip_with(chosen, rejected, (x, y) -> coalesce(x.role = y.role and x.text = y.text, false))"
    rows = pairs.select("pair_id", "chosen", "rejected").withColumn("n", F.expr(f"array_position({same}, false)"))
    rows = rows.withColumn("n", F.expr("cast(if(n > 0, n - 1, size(chosen)) as int)"))
    tail = lambda side: f"slice({side}, n + 1, greatest(size({side}) - n, 0))"
    text = lambda turns: F.expr(f"array_join(transform({turns}, t -> {_RENDER}), '')")

    def mask(side: str):
        start, end = "a.at + length(t.role) + 5", f"a.at + length({_RENDER}) - 1"
        grown = f"if(t.role = '{learn_role}', concat(a.spans, array(concat({start}, ':', {end}))), a.spans)"
        step = f"(a, t) -> named_struct('at', a.at + length({_RENDER}), 'spans', {grown})"
        return F.expr(f"array_join(aggregate({tail(side)}, named_struct('at', 0, 'spans', cast(array() as array<string>)), {step}, a -> a.spans), ',')")

    return rows.select(
        "pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"), text("slice(chosen, 1, n)").alias("prompt"), text(tail("chosen")).alias("chosen"), text(tail("rejected")).alias("rejected"),
        mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"))
