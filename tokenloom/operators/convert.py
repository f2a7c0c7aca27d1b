"""Converters: ten raw layouts to ``(instruction, context, response, source)``.

A converter keeps every input row. A row it cannot use gets a NULL instruction,
which the filter chain reports as ``fmt``. Presence and stripping rules differ
between sources on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import evaluated_once, let
from tokenloom.functions.text import (
    py_strip,
    strip_or_empty,
    text_after,
    text_before,
    truthy,
    with_system_prefix,
)

Converter = Callable[[DataFrame], DataFrame]
UNIFIED = ["instruction", "context", "response", "source"]


def _unified(
    df: DataFrame, source: str, instruction: Column, response: Column, context: Column | None = None
) -> DataFrame:
    """Put the unified columns beside the row's own keys."""
    made = evaluated_once(
        df,
        _keys(df),
        instruction=instruction,
        context=F.lit("") if context is None else context,
        response=response,
    )
    return made.withColumn("source", F.lit(source))


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in ("ord", "example_id")]


def _only_complete(df: DataFrame) -> DataFrame:
    """Blank out rows that lack an instruction or a response."""
    whole = truthy(F.col("instruction")) & truthy(F.col("response"))
    return df.select(
        *[
            F.when(whole, F.col(c)).alias(c) if c in UNIFIED[:3] else F.col(c)
            for c in df.columns
        ]
    )


def dolly(df: DataFrame) -> DataFrame:
    return _unified(
        df, "dolly", F.col("instruction"), F.col("response"), F.coalesce("context", F.lit(""))
    )


def alpaca(df: DataFrame) -> DataFrame:
    return _unified(
        df, "alpaca", F.col("instruction"), F.col("output"), F.coalesce("input", F.lit(""))
    )


def smol_smoltalk(df: DataFrame) -> DataFrame:
    """First user turn that has content at all, then the first assistant turn after it."""
    pair = _user_then_assistant(
        F.col("messages"), "role", "content", "user", "assistant", lambda v: v.isNotNull()
    )
    paired = df.select(*_keys(df), pair.alias("pair"))
    return _only_complete(
        _unified(paired, "smol-smoltalk", F.col("pair.human"), F.col("pair.answer"))
    )


def tulu3(df: DataFrame) -> DataFrame:
    """The first two turns have to be user and assistant, in this order."""
    first, second = (F.get("messages", F.lit(i)) for i in (0, 1))
    return _only_complete(
        _unified(
            df,
            "tulu3",
            F.when(first["role"] == "user", first["content"]),
            F.when(second["role"] == "assistant", second["content"]),
        )
    )


def guanaco(df: DataFrame) -> DataFrame:
    """First human part and the assistant part that follows, from one marked-up text."""
    after_human = text_after(F.col("text"), fv.HUMAN_MARK)
    answer = text_after(after_human, fv.ASSISTANT_MARK)
    question = F.when(answer.isNotNull(), text_before(after_human, fv.ASSISTANT_MARK))
    return _only_complete(
        _unified(
            df, "guanaco", py_strip(question), py_strip(text_before(answer, fv.HUMAN_MARK))
        )
    )


def openorca(df: DataFrame) -> DataFrame:
    return _only_complete(
        _unified(
            df,
            "openorca",
            with_system_prefix(strip_or_empty(F.col("system")), py_strip(F.col("instruction"))),
            py_strip(F.col("response")),
        )
    )


def slimorca(df: DataFrame) -> DataFrame:
    """Blank human turns are passed over; a system turn counts up to the answer."""
    pair = _user_then_assistant(
        F.col("conversations"),
        "from",
        "value",
        "human",
        "gpt",
        lambda v: py_strip(v) != "",
        system_role="system",
    )
    paired = df.select(*_keys(df), pair.alias("pair"))
    human = py_strip(F.col("pair.human"))
    system = strip_or_empty(F.col("pair.system"))
    return _only_complete(
        _unified(
            paired, "slimorca", with_system_prefix(system, human), py_strip(F.col("pair.answer"))
        )
    )


def gsm8k(df: DataFrame) -> DataFrame:
    return _only_complete(
        _unified(
            df, "gsm8k", strip_or_empty(F.col("question")), strip_or_empty(F.col("answer"))
        )
    )


def lmsys_chat(df: DataFrame) -> DataFrame:
    """Blank user turns are passed over; the first assistant turn after one ends the search."""
    pair = _user_then_assistant(
        F.col("conversation"), "role", "content", "user", "assistant", lambda v: py_strip(v) != ""
    )
    paired = df.select(*_keys(df), pair.alias("pair"))
    return _only_complete(
        _unified(
            paired,
            "lmsys-chat",
            py_strip(F.col("pair.human")),
            py_strip(F.col("pair.answer")),
        )
    )


def open_platypus(df: DataFrame) -> DataFrame:
    return _only_complete(
        _unified(
            df,
            "open-platypus",
            strip_or_empty(F.col("instruction")),
            strip_or_empty(F.col("output")),
            strip_or_empty(F.col("input")),
        )
    )


def _user_then_assistant(
    messages: Column,
    role: str,
    content: str,
    user: str,
    assistant: str,
    usable: Callable[[Column], Column],
    system_role: str | None = None,
) -> Column:
    """Struct ``(human, answer, system)`` of one nested message list.

    The list is numbered first; afterwards "first after" is a comparison of
    numbers. ``answer`` is the first assistant turn after the human one, usable
    or not. ``system`` is the first non-blank one before that answer.
    """
    numbered = F.transform(
        messages,
        lambda m, i: F.struct(i.alias("at"), m[role].alias("role"), m[content].alias("content")),
    )

    def of(turns: Column) -> Column:
        humans = F.filter(turns, lambda m: (m["role"] == user) & usable(m["content"]))
        return let(F.get(humans, F.lit(0)), lambda human: after(turns, human))

    def after(turns: Column, human: Column) -> Column:
        answers = F.filter(turns, lambda m: (m["role"] == assistant) & (m["at"] > human["at"]))
        return let(F.get(answers, F.lit(0)), lambda answer: named(turns, human, answer))

    def named(turns: Column, human: Column, answer: Column) -> Column:
        system = F.lit(None).cast("string")
        if system_role:
            earlier = F.filter(
                turns,
                lambda m: (m["role"] == system_role)
                & (py_strip(m["content"]) != "")
                & (m["at"] < answer["at"]),
            )
            system = F.get(earlier, F.lit(0))["content"]
        return F.struct(
            human["content"].alias("human"),
            answer["content"].alias("answer"),
            system.alias("system"),
        )

    return let(numbered, of)
