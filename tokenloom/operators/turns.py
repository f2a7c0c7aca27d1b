"""The chat converters for conversations stored as one row per turn.

The nested converters read a message list from one row. Here a conversation may
have any number of rows, so nothing is collected: "first turn that ..." is a
minimum, which Spark combines before the shuffle, and the one step that depends
on another ("the first answer after the first question") joins on conversation
and a block of turns, so that a very long conversation is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import py_strip, truthy, with_system_prefix

TURNS_PER_BLOCK = 65_536


def _first(condition: Column, content: Column) -> Column:
    """Earliest turn that meets the condition, as ``(turn, content)``."""
    return F.min(F.when(condition, F.struct(F.col("turn"), content.alias("content"))))


def first_pairs(turns: DataFrame, *, pass_over_blank: bool, strip: bool) -> DataFrame:
    """``(conv_id, system, human, answer)`` per conversation; missing parts are NULL.

    ``pass_over_blank`` looks for the first user turn with visible text instead of
    the first one whose text is not NULL.
    """
    text = py_strip(F.col("text")) if strip else F.col("text")
    t = turns.select(
        "conv_id",
        "turn",
        "role",
        text.alias("content"),
        F.call_function("div", F.col("turn"), F.lit(TURNS_PER_BLOCK)).alias("block"),
    )
    content = F.col("content")
    usable = truthy(py_strip(content)) if pass_over_blank else content.isNotNull()
    blocks = t.groupBy("conv_id", "block").agg(
        _first((F.col("role") == "user") & usable, content).alias("human"),
        _first((F.col("role") == "system") & truthy(py_strip(content)), content).alias("system"),
    )
    # One row per block of turns: small even for a conversation that holds most of the table.
    up_to_here = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    known = blocks.select(
        "conv_id",
        "block",
        F.min("human").over(up_to_here).alias("human"),
        F.min("system").over(up_to_here).alias("system"),
    )
    answers = (
        t.where(F.col("role") == "assistant")
        .join(known, ["conv_id", "block"])
        .where(F.col("turn") > F.col("human.turn"))
        .groupBy("conv_id", "block")
        .agg(_first(F.lit(True), content).alias("answer"))
        .groupBy("conv_id")
        .agg(F.min("answer").alias("answer"))
    )
    firsts = blocks.groupBy("conv_id").agg(
        F.min("human").alias("human"), F.min("system").alias("system")
    )
    return firsts.join(answers, "conv_id", "left").select(
        "conv_id",
        F.when(F.col("system.turn") < F.col("answer.turn"), F.col("system.content")).alias(
            "system"
        ),
        F.col("human.content").alias("human"),
        F.col("answer.content").alias("answer"),
    )


def opening_pairs(turns: DataFrame) -> DataFrame:
    """Turn 0 if a user wrote it and turn 1 if an assistant did, per conversation."""
    return turns.groupBy("conv_id").agg(
        F.max(F.when((F.col("turn") == 0) & (F.col("role") == "user"), F.col("text"))).alias(
            "human"
        ),
        F.max(F.when((F.col("turn") == 1) & (F.col("role") == "assistant"), F.col("text"))).alias(
            "answer"
        ),
    )


def as_examples(pairs: DataFrame, source: str, *, system_prefix: bool = False) -> DataFrame:
    """Unified examples keyed by ``ord`` (the conversation id); incomplete ones are NULL."""
    whole = truthy(F.col("human")) & truthy(F.col("answer"))
    human = F.col("human")
    if system_prefix:
        human = with_system_prefix(F.coalesce("system", F.lit("")), human)
    return pairs.select(
        F.col("conv_id").alias("ord"),
        F.when(whole, human).alias("instruction"),
        F.when(whole, F.lit("")).alias("context"),
        F.when(whole, F.col("answer")).alias("response"),
        F.lit(source).alias("source"),
    )
