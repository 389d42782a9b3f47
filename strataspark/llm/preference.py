"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions.

The longest common prefix of turns (same role and text) is rendered once, as the prompt; each side's other turns are its
completion, with a mask of spans (start, length in characters) that hold the assistant's turns, the text to learn.
``format_pairs`` takes given pairs of conversations; ``swapped`` makes pairs from a table without preference labels: the
rejected side is the conversation with its last answer replaced by that of the next conversation.

One aggregation per conversation (a conversation's turns are one row, as a document is) and one equi-join of the sides;
how many conversations share a turn does not matter. Defined cases: a null text or role is an empty one; turns are
ordered by (turn, role, text), so ties and repeated rows have one order and are kept; a null turn comes first; a missing side
gives an empty completion and ``paired`` false (its prompt is the other side's turns up to nothing: empty); sides of the same
turns are all prompt, with two empty completions, and ``equal``: nothing can be learnt from them; the largest long has no next
id, so that its conversation is unpaired with a null rejected_id; rows without conv_id take no part; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, CLOSE = "<|{}|>\n", "<|end|>\n"
LEARN = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns``: an ordered array of (role, text)."""
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return t.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Spans (start, length) of the assistant's texts with their close, in characters of the rendered turns."""
    head = lambda t: F.length(t["role"]) + 5  # noqa: E731  "<|", "|>", newline
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(_render(t))).cast("long").alias("at"),
        F.when(t["role"] == LEARN, F.concat(acc["spans"], F.array(F.struct((acc["at"] + head(t)).cast("long").alias("start"), (F.length(t["text"]) + len(CLOSE)).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs``: pair_id, chosen_id, rejected_id. A row per pair: prompt_turns, prompt, chosen, rejected and their masks."""
    c = conversations(turns)
    return format_sides(pairs.join(c.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left").join(c.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left"))


def format_sides(both: DataFrame) -> DataFrame:
    """As format_pairs, of pair_id, chosen_id, rejected_id and the sides' turns ``a`` and ``b`` (null: a missing side)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = both.withColumn("paired", F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    both = both.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "paired", (F.col("paired") & (F.col("a") == F.col("b"))).alias("equal"), F.col("n").cast("long").alias("prompt_turns"), _text(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _text(rest("a")).alias("chosen"), _mask(rest("a")).alias("chosen_mask"), _text(rest("b")).alias("rejected"), _mask(rest("b")).alias("rejected_mask"))


def swapped(turns: DataFrame) -> DataFrame:
    """Pairs of a table without preference labels, a row per conversation: pair_id and chosen_id are its id, ``a`` its turns;
    rejected_id is the next id, ``b`` the same turns with the last answer replaced by the last answer of that conversation
    (null where either has none)."""
    c = conversations(turns).withColumn("last", F.array_max(F.transform("turns", lambda x, i: F.when(x["role"] == LEARN, i))))
    other = c.where("last is not null").select(F.try_subtract("conv_id", F.lit(1)).alias("conv_id"), F.expr("turns[last].text").alias("other"))
    both = c.join(other, "conv_id", "left")
    swap = F.transform("turns", lambda x, i: F.when(i == F.col("last"), F.struct(x["role"].alias("role"), F.col("other").alias("text"))).otherwise(x))
    return both.select(
        F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.try_add("conv_id", F.lit(1)).alias("rejected_id"), F.col("turns").alias("a"),
        F.when(F.col("last").isNotNull() & F.col("other").isNotNull(), swap).alias("b"))
