"""Multiple-choice items: one layout for all benchmarks, candidates, prediction, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.text import py_strip, subject_title
from tokenloom.operators.tokenizers import Tokenizer

ITEM_COLUMNS = ["bench", "item_id", "subject", "ctx", "candidates", "label"]


def _letter_map(letters: list[str]) -> Column:
    pairs: list[Column] = []
    for i, letter in enumerate(letters):
        pairs += [F.lit(letter), F.lit(i)]
    return F.create_map(*pairs)


def completion_items(rows: DataFrame) -> DataFrame:
    """Sentence completion: the context and its endings, each with a leading blank."""
    return rows.select(
        F.lit("hellaswag").alias("bench"),
        F.col("ind").cast("string").alias("item_id"),
        F.lit(None).cast("string").alias("subject"),
        "ctx",
        F.transform("endings", lambda e: F.concat(F.lit(" "), e)).alias("candidates"),
        F.col("label").cast("int").alias("label"),
    )


def _choice_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda c: F.concat(c, F.lit("\n"))), "")


def subject_items(rows: DataFrame) -> DataFrame:
    """Four lettered choices under a subject heading; an unknown answer letter is an error."""
    letters = F.array(*[F.lit(l) for l in fv.CHOICE_LETTERS])
    texts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("a", "b", "c", "d")])
    lettered = F.zip_with(letters, texts, lambda l, t: F.concat(l, F.lit(". "), t))
    letter = py_strip(F.col("answer"))
    index = F.try_element_at(_letter_map(fv.CHOICE_LETTERS), letter)
    return rows.select(
        F.lit("mmlu").alias("bench"),
        "item_id",
        "subject",
        F.concat(
            F.lit(fv.SUBJECT_PROMPT_HEAD),
            subject_title(F.col("subject")),
            F.lit(".\n\n"),
            F.coalesce("question", F.lit("")),
            F.lit("\n"),
            _choice_lines(lettered),
            F.lit(fv.ANSWER_PROMPT),
        ).alias("ctx"),
        F.transform(lettered, lambda c: F.concat(F.lit(" "), c)).alias("candidates"),
        F.when(
            index.isNull(),
            F.raise_error(F.concat(F.lit("unknown answer "), letter)).cast("int"),
        )
        .otherwise(index)
        .alias("label"),
    )


def science_items(rows: DataFrame) -> DataFrame:
    """Choices under their own labels; the answer is found by label, else by position, else 0."""
    texts, labels = F.col("question.choices.text"), F.col("question.choices.label")
    lettered = F.zip_with(labels, texts, lambda l, t: F.concat(l, F.lit(". "), t))
    fallback = F.create_map(*[F.lit(v) for pair in fv.FALLBACK_LABELS.items() for v in pair])
    at = F.array_position(labels, F.col("answerKey"))
    return rows.select(
        F.lit("arc").alias("bench"),
        F.col("id").alias("item_id"),
        F.lit(None).cast("string").alias("subject"),
        F.concat(
            F.col("question.stem"), F.lit("\n"), _choice_lines(lettered), F.lit(fv.ANSWER_PROMPT)
        ).alias("ctx"),
        F.transform(lettered, lambda c: F.concat(F.lit(" "), c)).alias("candidates"),
        F.when(at > 0, (at - 1).cast("int"))
        .otherwise(F.coalesce(F.try_element_at(fallback, F.col("answerKey")), F.lit(0)))
        .alias("label"),
    )


def nested_science_rows(pages: DataFrame) -> DataFrame:
    """Unpack pages of flat rows into the nested item layout.

    Pages count in offset order up to the first empty one.
    """
    first_empty = pages.agg(F.min(F.when(F.size("rows") == 0, F.col("offset")))).scalar()
    return (
        pages.where(F.coalesce(F.col("offset") < first_empty, F.lit(True)))
        .select("offset", F.posexplode("rows").alias("at", "entry"))
        .select(
            (F.col("offset") + F.col("at")).alias("ord"),
            F.col("entry.row.id").alias("id"),
            F.struct(
                F.col("entry.row.question").alias("stem"),
                F.col("entry.row.choices").alias("choices"),
            ).alias("question"),
            F.col("entry.row.answerKey").alias("answerKey"),
        )
    )


def candidate_tokens(items: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """One row per item and candidate: context and candidate tokens, mask 1 on the candidate.

    Delimiter text inside an item is ordinary text here.
    """
    rows = items.select(
        "bench",
        "item_id",
        "subject",
        "label",
        tokenizer.encode(F.col("ctx")).alias("ctx_tokens"),
        F.posexplode("candidates").alias("cand_idx", "candidate"),
    ).withColumn("cand_tokens", tokenizer.encode(F.col("candidate")))
    return rows.select(
        "bench",
        "item_id",
        "subject",
        "label",
        "cand_idx",
        F.concat("ctx_tokens", "cand_tokens").alias("tokens"),
        F.concat(
            F.array_repeat(F.lit(0), F.size("ctx_tokens")),
            F.array_repeat(F.lit(1), F.size("cand_tokens")),
        ).alias("mask"),
    )


def collated(candidates: DataFrame) -> DataFrame:
    """Zero-pad the candidates of an item to its longest one, for scorers that need matrices."""
    keys = ["bench", "item_id"]
    width = F.max(F.size("tokens")).over(Window.partitionBy(*keys))
    missing = F.col("_width") - F.size("tokens")
    zeros = F.array_repeat(F.lit(0), missing)
    return (
        candidates.withColumn("_width", width)
        .withColumn("mask", F.concat("mask", zeros))
        .withColumn("tokens", F.concat("tokens", zeros))
        .drop("_width")
    )


def on_rank(items: DataFrame, ordinal: str, rank: int, world: int) -> DataFrame:
    """The round-robin share of one worker."""
    return items.where(F.col(ordinal) % world == rank)


def candidate_scores(token_losses: DataFrame) -> DataFrame:
    """Mean loss over each candidate's own tokens.

    ``token_losses``: ``(bench, item_id, cand_idx, pos, loss, mask)`` where the loss
    at ``pos`` predicts token ``pos + 1`` and the mask is that of the predicted token.
    """
    return token_losses.groupBy("bench", "item_id", "cand_idx").agg(
        F.try_divide(F.sum(F.col("loss") * F.col("mask")), F.sum("mask")).alias("avg_loss")
    )


def predictions(scores: DataFrame) -> DataFrame:
    """The candidate with the lowest mean loss; ties go to the lower index."""
    return scores.groupBy("bench", "item_id").agg(
        F.min_by("cand_idx", F.struct("avg_loss", "cand_idx")).alias("predicted")
    )


def accuracy(predicted: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Share of right predictions over all items; 0 where there are none.

    An item without a prediction counts as wrong.
    """
    hit = F.coalesce((F.col("predicted") == F.col("label")).cast("int"), F.lit(0))
    return (
        items.select("bench", "item_id", "subject", "label")
        .join(predicted, ["bench", "item_id"], "left")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("n_correct"),
        )
        .withColumn(
            "accuracy",
            F.coalesce(
                F.try_divide(F.col("n_correct").cast("double"), F.col("n_items")), F.lit(0.0)
            ),
        )
    )
