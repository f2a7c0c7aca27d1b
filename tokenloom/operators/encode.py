"""Token sequences and loss masks of instruction examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import evaluated_once, trailing_run
from tokenloom.functions.text import py_strip, render_prompt, text_after, text_before
from tokenloom.operators.tokenizers import Tokenizer


def with_token_counts(examples: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Add ``prompt_len``, ``response_len`` (delimiter included) and ``n_tokens``.

    A tokenizer that needs Python runs here once, and its ids stay in the row.
    """
    prompt = render_prompt(F.col("instruction"), F.col("context"))
    if not tokenizer.native:
        return (
            examples.withColumn("prompt_ids", tokenizer.encode(prompt))
            .withColumn("response_ids", tokenizer.encode(py_strip(F.col("response"))))
            .withColumn("prompt_len", F.size("prompt_ids"))
            .withColumn("response_len", F.size("response_ids") + 1)
            .withColumn("n_tokens", F.col("prompt_len") + F.col("response_len"))
        )
    return evaluated_once(
        examples,
        ["*"],
        prompt_len=tokenizer.count(prompt),
        response_len=tokenizer.count(py_strip(F.col("response"))) + 1,
    ).withColumn("n_tokens", F.col("prompt_len") + F.col("response_len"))


def length_ok(
    max_tokens: int = fv.SEQUENCE_TOKENS, min_response: int = fv.MIN_RESPONSE_TOKENS
) -> Column:
    return (F.col("n_tokens") <= max_tokens) & (F.col("response_len") >= min_response)


def encode_examples(examples: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Add unpadded ``tokens`` and ``mask``; prompt and answer are tokenised separately.

    Expects the counts of :func:`with_token_counts`. The mask is 1 on the answer
    and on the delimiter that ends it.
    """
    if "prompt_ids" in examples.columns:
        prompt, answer = F.col("prompt_ids"), F.col("response_ids")
    else:
        prompt = tokenizer.encode(render_prompt(F.col("instruction"), F.col("context")))
        answer = tokenizer.encode(py_strip(F.col("response")))
    return examples.withColumn(
        "tokens", F.concat(prompt, answer, F.array(F.lit(tokenizer.eot_id)))
    ).withColumn(
        "mask",
        F.concat(
            F.array_repeat(F.lit(0).cast("tinyint"), F.col("prompt_len")),
            F.array_repeat(F.lit(1).cast("tinyint"), F.col("response_len")),
        ),
    )


def pad(encoded: DataFrame, eot_id: int, width: int = fv.SEQUENCE_TOKENS) -> DataFrame:
    """Pad at read time: tokens with the delimiter, the mask with 0."""
    missing = F.lit(width) - F.size("tokens")
    return encoded.withColumn(
        "mask",
        F.concat("mask", F.array_repeat(F.lit(0).cast("tinyint"), missing)),
    ).withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(eot_id), missing)))


def token_counts(padded: DataFrame, eot_id: int) -> DataFrame:
    """Counts read off padded rows.

    ``total_tokens`` leaves out every trailing delimiter, the real one too;
    ``response_tokens`` counts it; so total = prompt + response - 1.
    """
    first_one = F.array_position("mask", F.lit(1).cast("tinyint"))
    return (
        padded.withColumn(
            "total_tokens", F.size("tokens") - trailing_run(F.col("tokens"), eot_id)
        )
        .withColumn(
            "prompt_tokens",
            F.when(first_one > 0, (first_one - 1).cast("int")).otherwise(
                F.size(F.filter("mask", lambda m: m == 0))
            ),
        )
        .withColumn("response_tokens", F.size(F.filter("mask", lambda m: m == 1)))
    )


def decoded_text(padded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Add ``full_text``: the row without its trailing delimiters, decoded."""
    kept = F.size("tokens") - trailing_run(F.col("tokens"), tokenizer.eot_id)
    return padded.withColumn("full_text", tokenizer.decode(F.slice("tokens", F.lit(1), kept)))


def parsed_fields(rows: DataFrame, text: str = "full_text") -> DataFrame:
    """Add ``instruction``, ``input`` and ``response`` read back from a rendered text.

    The instruction runs to the nearest following head of either kind and falls
    back to the whole text; the answer starts at the first answer mark.
    """
    whole = F.col(text)
    after_instruction = text_after(whole, fv.INSTRUCTION_MARK)
    # NULL when no head follows; otherwise the shorter of the two candidates.
    heads = [fv.INPUT_HEAD, fv.RESPONSE_HEAD]
    has_head = F.lit(False)
    cut = after_instruction
    for head in heads:
        has_head = has_head | after_instruction.contains(head)
        cut = text_before(cut, head)
    instruction = F.when(F.coalesce(has_head, F.lit(False)), py_strip(cut)).otherwise(
        py_strip(whole)
    )
    after_input = text_after(whole, fv.INPUT_MARK)
    context = F.when(
        F.coalesce(after_input.contains(fv.RESPONSE_HEAD), F.lit(False)),
        py_strip(text_before(after_input, fv.RESPONSE_HEAD)),
    ).otherwise("")
    response = F.coalesce(py_strip(text_after(whole, fv.RESPONSE_MARK)), F.lit(""))
    return (
        rows.withColumn("instruction", instruction)
        .withColumn("input", context)
        .withColumn("response", response)
    )


def prompt_and_response(rows: DataFrame, text: str = "full_text") -> DataFrame:
    """Split a rendered text right after its first answer mark, without stripping."""
    after = text_after(F.col(text), fv.RESPONSE_MARK)
    return rows.withColumn(
        "prompt_text",
        F.when(
            after.isNotNull(),
            F.concat(text_before(F.col(text), fv.RESPONSE_MARK), F.lit(fv.RESPONSE_MARK)),
        ).otherwise(F.col(text)),
    ).withColumn("response_text", F.coalesce(after, F.lit("")))
