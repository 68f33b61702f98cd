"""Preference formatting: the longest common turn prefix of two conversations once as prompt, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
#: Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def conversations(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """Turns (by, turn, role, text) to one row for each conversation with its turns in order.

    Ties of the turn number are ordered by role and text, null numbers come first, null roles and texts become empty. A
    conversation is one row of the result, so its turns meet in one task; turns of many conversations do not.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def safe(text: Column) -> Column:
    """Text in which nothing reads as a mark of the template."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit(CLOSE + "\n"))


def tail(turn: Column) -> Column:
    return F.concat(safe(turn["text"]), F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), tail(t))), "")


def spans(turns: Column, role: str) -> Column:
    """[start, end) in characters of what is learned in the rendered turns: the role's texts with their end marks."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(head(t)) + F.length(tail(t))).cast("long").alias("at"),
        F.when(t["role"] == role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(t))).cast("long").alias("start"), (acc["at"] + F.length(head(t)) + F.length(tail(t)) - 1).cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """Pairs (..., chosen, rejected), both arrays of turns (role, text), to prompt, completions and masks.

    Adds prompt_turns, prompt, chosen_text, rejected_text, chosen_mask and rejected_mask, and drops the arrays. The prompt
    is the longest common prefix of whole turns; where one conversation is a prefix of the other, or both are equal, its
    completion is empty. Masks are lists of [start, end) in the completion. Null conversations have no turns. Columns of
    these names are replaced.
    """
    c, r = (F.coalesce(F.col(x), F.array().cast(f"array<{TURN}>")) for x in ("chosen", "rejected"))
    df = pairs.withColumn("chosen", c).withColumn("rejected", r)
    n = F.least(F.size("chosen"), F.size("rejected"))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    apart = F.filter(at, lambda i: ~F.get("chosen", i).eqNullSafe(F.get("rejected", i)))
    df = df.withColumn("prompt_turns", F.coalesce(F.get(apart, F.lit(0)), n))
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.size(side))
    df = df.withColumn("prompt", rendered(F.slice("chosen", 1, F.col("prompt_turns"))))
    for side in ("chosen", "rejected"):
        df = df.withColumn(f"{side}_text", rendered(rest(side))).withColumn(f"{side}_mask", spans(rest(side), role))
    return df.drop("chosen", "rejected")


def swapped_replies(convs: DataFrame, by: str = "conv_id", role: str = "assistant") -> DataFrame:
    """Pairs for conversations that have no rejected version: the last reply is swapped with the neighbour's.

    Turns after the last reply are cut off and appear on neither side. Neighbours are the ids 2k and 2k + 1. The rejected conversation ends with the neighbour's last reply; without a
    neighbour, or one that never replies, it ends before the reply. Conversations without a reply, or without an id, have
    an equal rejected version. One row for each conversation; columns other than `by` and turns are ignored.
    """
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == role, i + 1)), lambda i: i.isNotNull()))
    rows = convs.select(F.col(by).alias("__by"), "turns").withColumn("__last", last)
    other = rows.where(F.col("__by").isNotNull() & F.col("__last").isNotNull()).select(F.col("__by").bitwiseXOR(F.lit(1)).alias("__for"), F.get("turns", F.col("__last") - 1).alias("__reply"))
    df = rows.join(other, F.col("__by") == F.col("__for"), "left")
    cut = F.slice("turns", 1, F.col("__last") - 1)
    swapped = F.when(F.col("__reply").isNull(), cut).otherwise(F.concat(cut, F.array("__reply")))
    rejected = F.when(F.col("__last").isNull() | F.col("__by").isNull(), F.col("turns")).otherwise(swapped)
    chosen = F.when(F.col("__last").isNull(), F.col("turns")).otherwise(F.slice("turns", 1, F.col("__last")))
    return df.select(F.col("__by").alias(by), chosen.alias("chosen"), rejected.alias("rejected"))
