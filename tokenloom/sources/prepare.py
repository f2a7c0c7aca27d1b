"""Preparation of an instruction mix as one job: filter, cap, split, shards, metadata, report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.operators import analysis, encode, filters, split
from tokenloom.operators.langid import LanguageProfile
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.session import materialise
from tokenloom.sources import reports
from tokenloom.sources.shards import read_example_shards, write_example_shards

KEYS = ["source", "ord"]


def prepare_mix(
    examples: DataFrame,
    tokenizer: Tokenizer,
    path: str,
    *,
    profile: LanguageProfile | None = None,
    cap: int = fv.SOURCE_CAP,
    seed: int = fv.MIX_SEED,
    fraction: float = fv.HOLDOUT_FRACTION,
    rows_per_shard: int = fv.ROWS_PER_SHARD,
    max_tokens: int = fv.SEQUENCE_TOKENS,
    min_response: int = fv.MIN_RESPONSE_TOKENS,
) -> DataFrame:
    """Store ``path/examples`` and ``path/metadata``; the metadata row, read back.

    Reasons and cap are decided on keys. Texts are read again for kept rows alone, and move
    once, to their shard. The metadata names the values used, and counts the stored rows.
    ``(source, ord)`` has to identify a row; ``examples`` is read several times, so store it
    first unless it is a plain scan.
    """
    began = time.monotonic()
    spark = examples.sparkSession
    reasons = filters.capped_reasons(
        examples, tokenizer, cap=cap, profile=profile,
        max_tokens=max_tokens, min_response=min_response,
    )
    reasons = materialise(reasons, "prepared-reasons")
    kept = reasons.where(F.col("skip_reason").isNull()).select(*KEYS)
    places = split.row_shards(
        split.holdout_split(kept, KEYS, seed=seed, fraction=fraction), KEYS,
        seed=seed, rows_per_shard=rows_per_shard,
    )
    places = materialise(places, "prepared-places")
    rows = filters.kept_examples(
        examples, tokenizer, kept_keys=places, max_tokens=max_tokens, min_response=min_response
    )
    write_example_shards(rows.join(places, KEYS), tokenizer, f"{path}/examples")
    metadata = reports.mix_metadata(
        filters.skip_stats(reasons),
        prepared_examples(spark, path),
        time.monotonic() - began,
        seed=seed, sequence_tokens=max_tokens, fraction=fraction,
        rows_per_shard=rows_per_shard, min_response=min_response,
    )
    reports.write_metadata(metadata, f"{path}/metadata")
    return prepared_metadata(spark, path)


def prepared_examples(spark: SparkSession, path: str) -> DataFrame:
    return read_example_shards(spark, f"{path}/examples")


def prepared_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    return reports.read_metadata(spark, f"{path}/metadata")


def prepared_report(
    spark: SparkSession,
    tokenizer: Tokenizer,
    path: str,
    n_per_source: int = fv.SAMPLE_PER_SOURCE,
) -> DataFrame:
    """``(section, split, part, line)`` of a prepared folder: stored rows decoded, and its metadata.

    Row numbers and padding follow the values that the metadata names.
    """
    metadata = prepared_metadata(spark, path)
    used = metadata.select("shard_size", "sequence_length").first()
    padded = encode.pad(prepared_examples(spark, path), tokenizer.eot_id, used["sequence_length"])
    parts = [
        analysis.analysis_table(
            padded.where(F.col("split") == name), tokenizer, used["shard_size"]
        ).withColumn("split", F.lit(name))
        for name in ("train", "val")
    ]
    decoded = materialise(parts[0].unionByName(parts[1]), "report-table")
    return reports.split_report(decoded, metadata, n_per_source)
