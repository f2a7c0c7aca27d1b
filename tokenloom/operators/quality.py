"""Checks that return the offending rows or counts; an empty result means all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv

SPLITS = ("train", "val")


def require_split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split has to be one of {SPLITS}, not {split!r}")
    return split


def split_shards(rows: DataFrame, split: str) -> DataFrame:
    """Rows of one split (a partition filter on stored shards); no shard at all is an error."""
    found = rows.where(F.col("split") == require_split(split))
    if found.isEmpty():
        raise FileNotFoundError(f"no shards found for split {split}")
    return found


def misaligned_rows(tokens: DataFrame, masks: DataFrame, width: int) -> DataFrame:
    """Rows whose token and mask parts do not belong together or have the wrong width."""
    keys = ["split", "shard_id", "row_id"]
    return (
        tokens.join(masks, keys, "full")
        .withColumn("n_token", F.size("tokens"))
        .withColumn("n_mask", F.size("mask"))
        .where(
            F.col("tokens").isNull()
            | F.col("mask").isNull()
            | (F.col("n_token") != F.col("n_mask"))
            | (F.col("n_token") != width)
        )
        .select(*keys, "n_token", "n_mask")
    )


def shard_gaps(rows: DataFrame) -> DataFrame:
    """Splits whose shard numbers do not run from 0 without a hole."""
    return (
        rows.groupBy("split")
        .agg(F.count_distinct("shard_id").alias("n_shards"), F.max("shard_id").alias("last_shard"))
        .where(F.col("n_shards") != F.col("last_shard") + 1)
    )


def shards_before_gap(rows: DataFrame) -> DataFrame:
    """Rows of the shards 0, 1, ... up to the first missing number of each split."""
    shards = rows.select("split", F.col("shard_id").cast("bigint").alias("shard_id")).distinct()
    # A virtual shard -1 makes a missing shard 0 look like any other gap.
    known = shards.unionByName(
        shards.select("split").distinct().withColumn("shard_id", F.lit(-1).cast("bigint"))
    )
    followed = shards.select("split", (F.col("shard_id") - 1).alias("shard_id"))
    last = (
        known.join(followed, ["split", "shard_id"], "left_anti")
        .groupBy("split")
        .agg(F.min("shard_id").alias("_last"))
    )
    # One row for each of the two splits, so that the rows stay where they are.
    return rows.join(F.broadcast(last), "split").where(F.col("shard_id") <= F.col("_last")).drop("_last")


def id_range(rows: DataFrame, ids: str = "tokens", limit: int = fv.TOKEN_ID_LIMIT) -> DataFrame:
    """Smallest and largest id, and how many rows hold one outside ``[0, limit)``."""
    low, high = F.array_min(ids), F.array_max(ids)
    return rows.agg(
        F.min(low).alias("min_id"),
        F.max(high).alias("max_id"),
        F.count_if((low < 0) | (high >= limit)).alias("n_bad_rows"),
    )
