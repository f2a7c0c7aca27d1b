"""Edge rows of converters, text predicates, filters and the cap."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import text as tx
from tokenloom.operators import convert, filters, turns
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.sources import registry

MESSAGES = "ord bigint, messages array<struct<role string, content string>>"
CHAT = "ord bigint, conversation array<struct<role string, content string>>, language string"
TURNS = "ord bigint, conversations array<struct<`from` string, value string>>"


def convert_one(spark, converter, schema, row):
    got = converter(spark.createDataFrame([(0, *row)], schema)).first()
    return got["instruction"], got["context"], got["response"]


@pytest.mark.parametrize(
    "messages, want",
    [
        ([("user", ""), ("user", "q"), ("assistant", "a")], None),
        ([("user", None), ("user", "q"), ("assistant", "a")], ("q", "a")),
        (
            [("assistant", "x"), ("user", "q"), ("user", "r"), ("assistant", "a"), ("assistant", "b")],
            ("q", "a"),
        ),
        ([("user", " q "), ("assistant", " a ")], (" q ", " a ")),
        ([("user", "q"), ("assistant", None), ("assistant", "a")], None),
        ([], None),
    ],
)
def test_first_pair_strict(spark, messages, want):
    i, c, r = convert_one(spark, convert.smol_smoltalk, MESSAGES, [messages])
    assert (i, r) == (want or (None, None))
    assert c == ("" if want else None)


@pytest.mark.parametrize(
    "messages, want",
    [
        ([("user", "  "), ("user", " q "), ("assistant", " a ")], ("q", "a")),
        ([("user", "q"), ("assistant", " "), ("assistant", "a")], None),
        ([("user", "q")], None),
        (None, None),
    ],
)
def test_first_pair_passing_over_blank(spark, messages, want):
    i, _, r = convert_one(spark, convert.lmsys_chat, CHAT, [messages, "English"])
    assert (i, r) == (want or (None, None))


@pytest.mark.parametrize(
    "messages, want",
    [
        ([("system", "s"), ("user", "q"), ("assistant", "a")], None),
        ([("user", "q")], None),
        ([("user", "q"), ("assistant", "a"), ("user", "z")], ("q", "a")),
        ([("user", ""), ("assistant", "a")], None),
    ],
)
def test_opening_pair(spark, messages, want):
    i, _, r = convert_one(spark, convert.tulu3, MESSAGES, [messages])
    assert (i, r) == (want or (None, None))


@pytest.mark.parametrize(
    "messages, want",
    [
        ([("system", "1234567890"), ("human", "q"), ("gpt", "a")], "q"),
        ([("system", "12345678901"), ("human", "q"), ("gpt", "a")], "12345678901\n\nq"),
        ([("human", "q"), ("system", "12345678901"), ("gpt", "a")], "12345678901\n\nq"),
        ([("human", "q"), ("gpt", "a"), ("system", "12345678901")], "q"),
        ([("human", "q"), ("gpt", ""), ("gpt", "a")], None),
        ([("system", None), ("human", "q"), ("gpt", "a")], "q"),
    ],
)
def test_system_prefix(spark, messages, want):
    assert convert_one(spark, convert.slimorca, TURNS, [messages])[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("### Human: q### Assistant: a### Human: r### Assistant: b", ("q", "a")),
        ("### Human: q", (None, None)),
        ("### Human: q\nmore ### Assistant: \n a \n", ("q\nmore", "a")),
        ("### Assistant: a### Human: q", (None, None)),
        ("### Human: ### Assistant: a", (None, None)),
        ("no marks", (None, None)),
    ],
)
def test_marked_up_text(spark, text, want):
    i, _, r = convert_one(spark, convert.guanaco, "ord bigint, text string", [text])
    assert (i, r) == want


def test_flat_sources(spark):
    flat = "ord bigint, instruction string, context string, response string"
    assert convert_one(spark, convert.dolly, flat, ["", None, ""]) == ("", "", "")
    three = "ord bigint, instruction string, input string, output string"
    assert convert_one(spark, convert.alpaca, three, ["i", None, " o "]) == ("i", "", " o ")
    assert convert_one(spark, convert.open_platypus, three, [" i ", " ctx ", "o"]) == ("i", "ctx", "o")
    assert convert_one(spark, convert.open_platypus, three, [None, "x", "o"])[0] is None
    pair = "ord bigint, question string, answer string"
    assert convert_one(spark, convert.gsm8k, pair, [" q ", None])[0] is None
    assert convert_one(spark, convert.gsm8k, pair, [" q ", "a"])[0] == "q"
    orca = "ord bigint, instruction string, system string, response string"
    assert convert_one(spark, convert.openorca, orca, ["q", None, "a"])[0] == "q"
    assert convert_one(spark, convert.openorca, orca, ["", "long enough system", "a"])[0] == (
        "long enough system\n\n"
    )


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError):
        registry.source("nope")
    assert len(registry.source_names()) == 10
    rows = [(0, [("user", "q"), ("assistant", "a")], "English"), (1, [("user", "q")], "Spanish")]
    spark.createDataFrame(rows, CHAT).write.parquet(str(tmp_path / "chat"))
    mix = registry.read_mix(spark, {"lmsys-chat": str(tmp_path / "chat")})
    assert mix.count() == 1
    registry.register_source("own", "ord bigint, t string", lambda df: df.selectExpr(
        "ord", "t AS instruction", "'' AS context", "t AS response", "'own' AS source"))
    try:
        assert "own" in registry.source_names()
    finally:
        del registry._SOURCES["own"]


STRIP_CASES = ["", " ", "\t\n x \x1c", "　é ", "a b", "\x85\xa0", "​ x", "a\n\n"]


def test_strip_like_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(STRIP_CASES)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", tx.py_strip(F.col("t")).alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(STRIP_CASES)}


ENGLISH = "a perfectly plain english sentence with enough words in it"


@pytest.mark.parametrize(
    "text, want",
    [
        (None, False),
        ("", False),
        ("   ninechars   "[:12], False),
        ("  123456789  ", False),
        ("  1234567890  ", True),
        (ENGLISH + "Ж", False),
        (ENGLISH + "中", False),
        (ENGLISH + "ع", False),
        (ENGLISH + "한", False),
        ("x" * 99 + "α", True),
        ("x" * 90 + "é" * 10, True),
        ("x" * 89 + "é" * 11, False),
    ],
)
def test_native_english(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.passes_native_english_checks(F.col("t"))).first()[0] is want


def test_prompt(spark):
    cases = [
        (" i ", "", "### Instruction:\ni\n\n### Response:\n"),
        (" i ", "  ", "### Instruction:\ni\n\n### Response:\n"),
        ("i", " c ", "### Instruction:\ni\n\n### Input:\nc\n\n### Response:\n"),
    ]
    df = spark.createDataFrame([(k, i, c) for k, (i, c, _) in enumerate(cases)], "k int, i string, c string")
    got = df.select("k", tx.render_prompt(F.col("i"), F.col("c")).alias("p")).collect()
    assert {r["k"]: r["p"] for r in got} == {k: w for k, (_, _, w) in enumerate(cases)}


def example(spark, instruction, context, response):
    schema = "ord bigint, instruction string, context string, response string, source string"
    return spark.createDataFrame([(0, instruction, context, response, "s")], schema)


def reason(spark, instruction, context, response):
    df = filters.skip_reasons(example(spark, instruction, context, response), ByteTokenizer())
    return df.first()["skip_reason"]


def test_filter_order(spark):
    head = len("### Instruction:\ni\n\n### Response:\n")
    assert reason(spark, None, None, None) == "fmt"
    assert reason(spark, "Ж", "", "short") == "lang"
    assert reason(spark, "i", "Ж", "x" * 31) is None
    assert reason(spark, "i", "", "x" * 30) == "len"
    assert reason(spark, "i", "", "x" * (1025 - head - 1)) is None
    assert reason(spark, "i", "", "x" * (1025 - head)) == "len"


@pytest.mark.parametrize("cap, want", [(2, (2, 1, 0)), (0, (3, 1, 1)), (3, (3, 1, 1)), (1, (1, 0, 0))])
@pytest.mark.parametrize("buckets", [1, 3])
def test_cap_counts(spark, cap, want, buckets):
    outcomes = [None, "lang", None, "len", None]
    df = spark.createDataFrame(
        [("s", i, o) for i, o in enumerate(outcomes)], "source string, ord bigint, skip_reason string"
    )
    stats = filters.skip_stats(filters.cap_per_source(df, cap, buckets=buckets))
    row = stats.where("source = 's'").first()
    assert (row["kept"], row["skipped_not_english"], row["skipped_too_long_or_short"]) == want


def test_turn_rows_agree_with_nested_lists(spark, monkeypatch):
    """The row-per-turn form against the nested form, with blocks of two turns."""
    monkeypatch.setattr(turns, "TURNS_PER_BLOCK", 2)
    import itertools

    roles = ["system", "user", "assistant"]
    texts = ["", " ", "long enough text"]
    options = list(itertools.product(roles, texts))
    conversations = [list(c) for c in itertools.islice(itertools.product(options, repeat=4), 0, 6561, 37)]
    rows = [
        (k, t, role, text) for k, c in enumerate(conversations) for t, (role, text) in enumerate(c)
    ]
    flat = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    nested = spark.createDataFrame(
        [(k, c, "English") for k, c in enumerate(conversations)], CHAT
    )

    def table_of(df):
        return {r["ord"]: (r["instruction"], r["response"]) for r in df.collect()}

    blank = turns.first_pairs(flat, pass_over_blank=True, strip=True)
    assert table_of(turns.as_examples(blank, "x")) == table_of(convert.lmsys_chat(nested))
    strict = turns.first_pairs(flat, pass_over_blank=False, strip=False)
    messages = nested.withColumnRenamed("conversation", "messages")
    assert table_of(turns.as_examples(strict, "x")) == table_of(convert.smol_smoltalk(messages))
    assert table_of(turns.as_examples(turns.opening_pairs(flat), "x")) == table_of(
        convert.tulu3(messages)
    )
    as_chat = nested.select(
        "ord",
        F.transform(
            "conversation",
            lambda m: F.struct(
                F.when(m["role"] == "user", "human")
                .when(m["role"] == "assistant", "gpt")
                .otherwise(m["role"])
                .alias("from"),
                m["content"].alias("value"),
            ),
        ).alias("conversations"),
    )
    assert table_of(turns.as_examples(blank, "x", system_prefix=True)) == table_of(
        convert.slimorca(as_chat)
    )
