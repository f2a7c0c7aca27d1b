"""Descriptive tables of a prepared instruction mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import permutation_key
from tokenloom.operators.encode import decoded_text, parsed_fields, token_counts
from tokenloom.operators.tokenizers import Tokenizer

TOKEN_COLUMNS = ["total_tokens", "prompt_tokens", "response_tokens"]


def shard_prefix(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The first ``max_rows`` rows in shard order; 0 or None means all of them."""
    return rows.orderBy("shard_id", "row_id").limit(max_rows) if max_rows else rows


def analysis_table(
    padded: DataFrame,
    tokenizer: Tokenizer,
    rows_per_shard: int = fv.ROWS_PER_SHARD,
) -> DataFrame:
    """Eight columns per example: index, source, parsed fields and token counts."""
    counted = token_counts(padded, tokenizer.eot_id)
    fields = parsed_fields(decoded_text(counted, tokenizer))
    index = F.col("shard_id").cast("bigint") * rows_per_shard + F.col("row_id")
    return fields.select(
        index.alias("index"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        "instruction",
        "input",
        "response",
        *TOKEN_COLUMNS,
    )


def _melted(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*by, *columns).unpivot(by, columns, "column", "value")


def column_stats(
    rows: DataFrame, by: list[str], columns: list[str] = TOKEN_COLUMNS
) -> DataFrame:
    """Mean, exact median, minimum and maximum per column.

    Exact percentiles keep one counter per distinct value; token counts are at
    most the sequence length, so the state is small however many rows there are.
    """
    return (
        _melted(rows, by, columns)
        .groupBy(*by, "column")
        .agg(
            F.avg("value").alias("mean"),
            F.median("value").alias("median"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def describe(
    rows: DataFrame,
    by: list[str],
    columns: list[str] = TOKEN_COLUMNS,
    *,
    approximate: bool = False,
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one digit each."""
    quartiles = [0.25, 0.5, 0.75]
    q = F.percentile_approx("value", quartiles) if approximate else F.percentile("value", quartiles)
    summary = (
        _melted(rows, by, columns)
        .groupBy(*by, "column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            q.alias("q"),
            F.max("value").alias("max"),
        )
    )
    one = lambda c: F.round(c.cast("double"), 1)
    return summary.select(
        *by,
        "column",
        "count",
        one(F.col("mean")).alias("mean"),
        one(F.col("std")).alias("std"),
        one(F.col("min")).alias("min"),
        *[one(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(["p25", "p50", "p75"])],
        one(F.col("max")).alias("max"),
    )


def source_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per source, largest first; empty when there is only one source."""
    by = by or []
    counts = rows.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))
    # One row per source reaches this window, not the data.
    return (
        counts.withColumn("_sources", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .where("_sources > 1")
        .drop("_sources")
        .orderBy(*by, F.desc("n"), "source")
    )


def distinct_sources(rows: DataFrame, *, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count(F.col("source")).alias("n_sources"))


def sample_per_source(
    rows: DataFrame,
    key: str,
    n: int = fv.SAMPLE_PER_SOURCE,
    seed: int = fv.SAMPLE_SEED,
    group: str = "source",
) -> DataFrame:
    """``min(n, size)`` rows of each group, by a seeded order of their keys.

    A rank filter lets Spark drop all but ``n`` rows per group before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(permutation_key(seed, F.col(key)))
    return (
        rows.withColumn("sample_rank", F.row_number().over(order))
        .where(F.col("sample_rank") <= n)
        .orderBy(group, "sample_rank")
    )


def shard_row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "shard_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("row_id").alias("last_row_id")
    )
