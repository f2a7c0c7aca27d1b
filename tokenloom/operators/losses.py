"""Token losses from a scorer, and the ways to average them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.arrays import let
from tokenloom.functions.rates import cross_entropy
from tokenloom.operators.lookup import lookup_join

# A scorer takes rows with ``tokens`` and adds ``losses``: one number per position
# except the last, each predicting the next token. A neural model plugs in here as
# ``pyspark.ml.functions.predict_batch_udf`` or ``mapInPandas``.
Scorer = Callable[[DataFrame], DataFrame]


def next_token_counts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(prev, next, n)`` over all neighbouring tokens, combined before the shuffle."""

    def pairs(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.arrays_zip(
            F.slice(t, F.lit(1), n).alias("prev"), F.slice(t, F.lit(2), n).alias("next")
        )

    return (
        rows.select(F.inline(let(F.col(tokens), pairs)).alias("prev", "next"))
        .groupBy("prev", "next")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def counting_scorer(counts: DataFrame, vocab_size: int, keys: list[str]) -> Scorer:
    """A scorer from next-token counts, so that evaluation runs without a neural model.

    Add-one smoothed. Its tables have a row for every pair and every first token that
    occur, for a vocabulary of any size; small ones are broadcast behind a size check.
    """
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    unseen = F.ln(F.lit(float(vocab_size)))

    def score(rows: DataFrame) -> DataFrame:
        """``(*keys, pos, loss, mask)``; the mask is that of the predicted token."""
        n = F.greatest(F.size("tokens") - 1, F.lit(0))
        mask = F.col("mask") if "mask" in rows.columns else F.array_repeat(F.lit(1), F.size("tokens"))
        steps = F.arrays_zip(
            F.slice("tokens", F.lit(1), n).alias("prev"),
            F.slice("tokens", F.lit(2), n).alias("next"),
            F.slice(mask, F.lit(2), n).alias("mask"),
        )
        stepped = rows.select(*keys, F.posexplode(steps).alias("pos", "step"))
        flat = stepped.select(*keys, "pos", "step.prev", "step.next", "step.mask")
        spread_by = F.xxhash64(*keys, "pos")
        found = lookup_join(flat, counts, ["prev", "next"], spread_by=spread_by)
        found = lookup_join(found, totals, ["prev"], spread_by=spread_by)
        seen = F.coalesce(F.col("n"), F.lit(0)) + F.lit(1.0)
        loss = -F.ln(seen / (F.col("total") + F.lit(float(vocab_size))))
        return found.select(*keys, "pos", F.coalesce(loss, unseen).alias("loss"), "mask")

    return score


def losses_from_logits(rows: DataFrame, logits: str, target: str) -> DataFrame:
    """Add ``loss``: cross entropy of one 0-based target under one logit vector."""
    return rows.withColumn(
        "loss", cross_entropy(F.col(logits).cast("array<double>"), F.col(target))
    )


def mean_of_batch_means(
    token_losses: DataFrame, first_batches: int, batch: str = "batch_id"
) -> DataFrame:
    """Mean of the plain means of the first batches."""
    per_batch = (
        token_losses.where(F.col(batch) < first_batches).groupBy(batch).agg(F.avg("loss").alias("m"))
    )
    return per_batch.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("m").alias("loss"))


def mean_of_running_batches(
    token_losses: DataFrame, running: int, batch: str = "batch_id"
) -> DataFrame:
    """Mean of the plain means of ``running`` batches in a row, from the first one again after the last.

    Where the pass has fewer batches, its first ones count once more than the others.
    """
    first = token_losses.where(F.col(batch) < running)
    per_batch = first.groupBy(F.col(batch).alias("b")).agg(F.avg("loss").alias("m"))
    # At most ``running`` entries.
    held = per_batch.agg(F.collect_list(F.struct("b", "m")).alias("means"))
    size = F.size("means").cast("bigint")
    times = lambda b: F.call_function("div", F.lit(running) - 1 - b, size) + 1
    total = F.aggregate("means", F.lit(0.0), lambda s, x: s + x["m"] * times(x["b"]))
    return held.select(
        F.size("means").cast("bigint").alias("n_batches"),
        F.when(size > 0, total / running).alias("loss"),
    )


def masked_batch_sums(token_losses: DataFrame, by: list[str]) -> DataFrame:
    """Per batch: masked loss sum, and active tokens but never less than one."""
    return token_losses.groupBy(*by).agg(
        F.sum(F.col("loss") * F.col("mask")).alias("loss_sum"),
        F.greatest(F.sum("mask"), F.lit(1)).cast("bigint").alias("n_active"),
    )


def mean_of_masked_means(batch_sums: DataFrame) -> DataFrame:
    return batch_sums.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg(F.col("loss_sum") / F.col("n_active")).alias("loss"),
    )


def token_weighted_loss(batch_sums: DataFrame) -> DataFrame:
    return batch_sums.agg(
        F.sum("n_active").cast("bigint").alias("n_active"),
        F.try_divide(F.sum("loss_sum"), F.sum("n_active")).alias("loss"),
    )
