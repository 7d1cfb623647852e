"""Preference formatting of conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text alike) is rendered once
as the prompt; what follows in either is its completion, rendered as segments with a mask that says which characters are
trained on (the assistant's words and their end mark, not the headers nor other roles' turns).

All of it is DataFrame functions: turns are gathered per conversation (a conversation is one row's worth of text by its
nature), and pairs meet by conversation id.

Where no pairs are given, ``pair_by_opening`` makes them: conversations that begin with the same turn are paired, within blocks
of ``BLOCK`` ids so that an opening which many share is no single task's; what is left is paired by number, 2k with 2k + 1. Of a
pair the one with the longer answers is chosen, of equally long ones that with the lesser id.

Defined results: null role or text counts as empty; repeated turns (same conversation and turn number) are ordered by role
and text and all kept; turns without a number come first; a conversation without a partner gives no pair; two alike
conversations give a prompt and empty completions; empty tables give an empty result; extra columns are not carried; a
conversation is one row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks.
HEADER, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
#: Ids of one block of conversations with the same opening.
BLOCK = 128


def gather(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (role, text)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEADER), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def spans(turns: Column) -> Column:
    """Half-open character spans of the rendered turns that are trained on."""

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_header(t))
        end = start + F.length(t["text"]) + len(END)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == TRAINED, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns both begin with: the first place where they differ."""
    alike = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(alike, False), F.lit(0)) - 1, F.size(alike).cast("long"))


def format_pairs(gathered: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen_id, rejected_id) as prompt, both completions, and the spans trained on in each."""
    side = lambda name: gathered.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns"))
    both = pairs.select("chosen_id", "rejected_id").join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id")
    n = both.withColumn("n_common", common_prefix(F.col("chosen_turns"), F.col("rejected_turns")))
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.size(c))
    return n.select(
        "chosen_id", "rejected_id", "n_common",
        render(F.slice("chosen_turns", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        render(rest("chosen_turns")).alias("chosen"), render(rest("rejected_turns")).alias("rejected"),
        spans(rest("chosen_turns")).alias("chosen_spans"), spans(rest("rejected_turns")).alias("rejected_spans"),
    )


def _answers() -> Column:
    """Characters of a conversation's answers."""
    return F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.when(t["role"] == TRAINED, F.length(t["text"])).otherwise(0))


def _paired(keyed: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id) of every ``pair`` of two of ``keyed`` (pair, conv_id, n)."""
    x = F.struct("n", (-F.col("conv_id")).alias("k"))
    both = keyed.groupBy("pair").agg(F.max(x).alias("best"), F.min(x).alias("worst"), F.count(F.lit(1)).alias("m")).filter(F.col("m") == 2)
    return both.select((-F.col("best.k")).alias("chosen_id"), (-F.col("worst.k")).alias("rejected_id"))


def pair_by_number(gathered: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations whose ids are 2k and 2k + 1."""
    return _paired(gathered.select(F.floor(F.col("conv_id") / 2).alias("pair"), "conv_id", _answers().alias("n")))


def pair_by_opening(gathered: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations with the same first turn, then those left by number."""
    first = F.get("turns", F.lit(0))
    opened = gathered.select("conv_id", _answers().alias("n"), F.xxhash64(first["role"], first["text"]).alias("opening"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    group = Window.partitionBy("opening", "block")
    placed = opened.withColumns({"place": F.row_number().over(group.orderBy("conv_id")) - 1, "of": F.count(F.lit(1)).over(group)})
    alike = F.col("place") < F.col("of") - F.col("of") % 2
    by_number = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("opening"), F.lit(0).cast("long").alias("block"), F.floor(F.col("conv_id") / 2).alias("at"))
    by_opening = F.struct(F.lit(1).alias("kind"), "opening", F.col("block").cast("long").alias("block"), F.floor(F.col("place") / 2).alias("at"))
    return _paired(placed.select(F.when(alike, by_opening).otherwise(by_number).alias("pair"), "conv_id", "n"))
