"""Seeded hold-out, second shuffle and row shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import permutation_key
from tokenloom.operators.prefix import shuffled_rank


def holdout_size(n: Column, fraction: float = fv.HOLDOUT_FRACTION) -> Column:
    """At least one row of any non-empty table."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(float(fraction))).cast("bigint"))


def holdout_split(
    examples: DataFrame,
    keys: list[str],
    *,
    seed: int = fv.MIX_SEED,
    fraction: float = fv.HOLDOUT_FRACTION,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``split``: the first rows of a seeded permutation validate, the others train.

    Pass keys only, and join wide rows afterwards.
    """
    ranked = shuffled_rank(
        examples,
        permutation_key(seed, *[F.col(k) for k in keys]),
        out="_perm",
        total="_n_all",
        buckets=buckets,
    )
    return ranked.withColumn(
        "split",
        F.when(F.col("_perm") < holdout_size(F.col("_n_all"), fraction), F.lit("val")).otherwise(
            F.lit("train")
        ),
    ).drop("_perm", "_n_all")


def row_shards(
    split_rows: DataFrame,
    keys: list[str],
    *,
    seed: int = fv.MIX_SEED,
    rows_per_shard: int = fv.ROWS_PER_SHARD,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``shard_id`` and ``row_id``: a fresh permutation of each split in equal groups."""
    numbered = shuffled_rank(
        split_rows,
        permutation_key(seed + 1, *[F.col(k) for k in keys]),
        by=["split"],
        out="_row",
        buckets=buckets,
    )
    row = F.coalesce(F.col("_row"), F.lit(0))
    return (
        numbered.withColumn(
            "shard_id", F.call_function("div", row, F.lit(rows_per_shard)).cast("int")
        )
        .withColumn("row_id", (row % rows_per_shard).cast("int"))
        .drop("_row")
    )


def kept_outside(examples: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """Examples that are not in the held-out set."""
    return examples.join(held_out.select(*keys), keys, "left_anti")


def kept_inside(examples: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    return examples.join(held_out.select(*keys), keys, "left_semi")
