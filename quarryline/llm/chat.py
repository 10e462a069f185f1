"""Preference formatting of pairs of conversations, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "<|im_start|>", "<|im_end|>\n"


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    """An array of turns as text: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, learn: str = "assistant") -> Column:
    """The loss mask of render(turns) as runs ``length:flag``, in characters: what the role ``learn`` says,
    with its end mark, is learnt (1), all else isn't (0)."""
    flag = lambda t: F.when(t["role"] == learn, F.lit("1")).otherwise(F.lit("0"))
    runs = lambda t: F.concat(F.length(_head(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"), F.lit(":"), flag(t))
    return F.array_join(F.transform(turns, runs), ",")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn, then role, then text."""
    one = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(one)).alias("turns"))


def preferences(turns: DataFrame, pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row for each row of ``pairs`` (pair_id, chosen_id, rejected_id) whose conversations both have turns.

    n_prefix: turns in the longest common prefix, equal in role and text (nulls equal each other),
    whatever their numbers. prompt: the prefix, rendered once. chosen, rejected: what follows in either
    conversation; chosen_mask, rejected_mask: their loss masks, see mask(). n_chosen, n_rejected: their turns.

    Repeated rows of ``turns`` count once; turns of one number are ordered by role and text; null roles
    and texts render as empty; rows with a null conv_id are ignored. Equal conversations have empty
    completions. Empty tables give no rows; further columns are ignored. A conversation becomes one row,
    as the output asks, and no two conversations meet but those of a pair.
    """
    c = conversations(turns.select("conv_id", "turn", "role", "text"))
    both = (
        pairs.select("pair_id", "chosen_id", "rejected_id")
        .join(c.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id")
        .join(c.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id")
    )
    shared = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.arrays_zip("c", "r"), lambda z: z["c"]["role"].eqNullSafe(z["r"]["role"]) & z["c"]["text"].eqNullSafe(z["r"]["text"]))
    differs = F.array_position(F.slice(same, F.lit(1), shared), F.lit(False))
    n = F.when(differs > 0, differs - 1).otherwise(shared).cast("int")
    rest = lambda a: F.slice(F.col(a), F.col("n_prefix") + 1, F.size(a))
    return (
        both.withColumn("n_prefix", n)
        .withColumns({"cc": rest("c"), "rr": rest("r")})
        .select(
            "pair_id",
            "chosen_id",
            "rejected_id",
            "n_prefix",
            F.size("cc").alias("n_chosen"),
            F.size("rr").alias("n_rejected"),
            render(F.slice("c", F.lit(1), F.col("n_prefix"))).alias("prompt"),
            render(F.col("cc")).alias("chosen"),
            render(F.col("rr")).alias("rejected"),
            mask(F.col("cc"), learn).alias("chosen_mask"),
            mask(F.col("rr"), learn).alias("rejected_mask"),
        )
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2 k (chosen) and 2 k + 1 (rejected), as (pair_id k, chosen_id, rejected_id)."""
    half = F.shiftright(F.col("conv_id").cast("long"), 1)
    return turns.where("conv_id is not null").select(half.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
