"""Metadata document, analysis CSV and preview report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.operators.analysis import (
    TOKEN_COLUMNS,
    column_stats,
    sample_per_source,
    source_counts,
)

METADATA_SCHEMA = (
    "seed INT, block_size INT, sequence_length INT, val_size DOUBLE, shard_size INT, "
    "min_response_tokens INT, datasets_used ARRAY<STRING>, per_dataset_stats MAP<STRING, "
    "STRUCT<kept: BIGINT, skipped_not_english: BIGINT, skipped_too_long_or_short: BIGINT, "
    "skipped_format: BIGINT>>, train STRUCT<examples: BIGINT, shards: BIGINT>, "
    "val STRUCT<examples: BIGINT, shards: BIGINT>, total_elapsed_s DOUBLE"
)


def mix_metadata(
    stats: DataFrame,
    rows: DataFrame,
    elapsed_s: float = 0.0,
    *,
    seed: int = fv.MIX_SEED,
    sequence_tokens: int = fv.SEQUENCE_TOKENS,
    fraction: float = fv.HOLDOUT_FRACTION,
    rows_per_shard: int = fv.ROWS_PER_SHARD,
    min_response: int = fv.MIN_RESPONSE_TOKENS,
) -> DataFrame:
    """One row that describes a prepared mix, with the values it was prepared by.

    ``stats`` has one row per source, so the map below holds as many entries as
    there are registered sources. ``rows`` is the table of example shards.
    """
    counters = ["kept", "skipped_not_english", "skipped_too_long_or_short", "skipped_format"]
    per_source = stats.where(F.col("source").isNotNull())
    named = per_source.agg(
        F.array_sort(F.collect_list("source")).alias("datasets_used"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("source", F.struct(*counters))))
        ).alias("per_dataset_stats"),
    )

    def count(split: str) -> Column:
        here = F.col("split") == split
        return F.struct(
            F.count_if(here).alias("examples"),
            F.count_distinct(F.when(here, F.col("shard_id"))).alias("shards"),
        )

    sizes = rows.agg(F.struct(count("train").alias("train"), count("val").alias("val")).alias("s"))
    return named.withColumn("_s", sizes.scalar()).select(
        F.lit(seed).alias("seed"),
        F.lit(sequence_tokens - 1).alias("block_size"),
        F.lit(sequence_tokens).alias("sequence_length"),
        F.lit(fraction).alias("val_size"),
        F.lit(rows_per_shard).alias("shard_size"),
        F.lit(min_response).alias("min_response_tokens"),
        "datasets_used",
        "per_dataset_stats",
        F.col("_s.train").alias("train"),
        F.col("_s.val").alias("val"),
        F.lit(round(float(elapsed_s), 1)).alias("total_elapsed_s"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """The metadata row, or None when the folder was never written."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        return None
    return spark.read.schema(METADATA_SCHEMA).json(path)


def source_stats_of(metadata: DataFrame) -> DataFrame:
    """Per-source counters of a metadata row as rows."""
    return metadata.select(F.explode("per_dataset_stats").alias("source", "stats")).select(
        "source", "stats.*"
    )


def write_analysis_csv(table: DataFrame, path: str) -> None:
    """Header and quoted text, so that multi-line fields survive."""
    table.write.csv(
        path,
        header=True,
        quoteAll=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_analysis_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "index BIGINT, source STRING, instruction STRING, input STRING, response STRING, "
        + ", ".join(f"{c} BIGINT" for c in TOKEN_COLUMNS)
    )
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("escape", '"')
        .option("nullValue", "\x00")
        .option("emptyValue", "")
        .csv(path, header=True)
    )


def preview_lines(
    table: DataFrame,
    n_per_source: int = fv.SAMPLE_PER_SOURCE,
    metadata: DataFrame | None = None,
) -> DataFrame:
    """``(section, part, line)`` of the preview report, in reading order.

    Sections: 1 metadata, 2 token statistics, 3 counts per source, 4 sampled
    examples. Every section is an aggregate or a fixed-size sample.
    """
    sections: list[DataFrame] = []
    if metadata is not None:
        stats = source_stats_of(metadata)
        sections.append(
            stats.select(
                F.lit(1).alias("section"),
                F.col("source").alias("part"),
                F.format_string(
                    "%-22s %,7d %,10d %,10d",
                    "source",
                    "kept",
                    "skipped_not_english",
                    "skipped_too_long_or_short",
                ).alias("line"),
            )
        )
    stats = column_stats(table, [])
    sections.append(
        stats.select(
            F.lit(2).alias("section"),
            F.col("column").alias("part"),
            F.format_string(
                "%-20s mean=%6.1f median=%6.1f min=%4d max=%4d",
                "column",
                "mean",
                "median",
                "min",
                "max",
            ).alias("line"),
        )
    )
    counts = source_counts(table)
    sections.append(
        counts.select(
            F.lit(3).alias("section"),
            F.concat(F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), "source").alias(
                "part"
            ),
            F.format_string("%-22s %,6d", "source", "n").alias("line"),
        )
    )
    sample = sample_per_source(table, "index", n_per_source)
    input_block = F.when(F.col("input") != "", F.concat(F.lit("INPUT:\n"), "input", F.lit("\n\n")))
    sections.append(
        sample.select(
            F.lit(4).alias("section"),
            F.concat("source", F.lit("\x1f"), F.lpad(F.col("sample_rank").cast("string"), 6, "0")).alias(
                "part"
            ),
            F.concat(
                F.format_string(
                    "[%s]  #%s  total=%d tok  (prompt=%d | response=%d)\n",
                    "source",
                    F.col("index").cast("string"),
                    *TOKEN_COLUMNS,
                ),
                F.lit("INSTRUCTION:\n"),
                "instruction",
                F.lit("\n\n"),
                F.coalesce(input_block, F.lit("")),
                F.lit("RESPONSE:\n"),
                "response",
            ).alias("line"),
        )
    )
    return reduce(lambda a, b: a.unionByName(b), sections)


def metadata_lines(metadata: DataFrame) -> DataFrame:
    """``(part, line)``: the values of a prepared mix, one line each."""
    sized = lambda s: F.format_string("%d  (%d shards)", f"{s}.examples", f"{s}.shards")
    values = {
        "Block size": F.col("block_size").cast("string"),
        "Sequence length": F.col("sequence_length").cast("string"),
        "Shard size": F.col("shard_size").cast("string"),
        "Min response tok": F.col("min_response_tokens").cast("string"),
        "Train examples": sized("train"),
        "Val examples": sized("val"),
    }
    lines = F.array(
        *[
            F.struct(
                F.lit(f"{i:02d}").alias("part"),
                F.concat(F.lit(f"{name:<17}: "), value).alias("line"),
            )
            for i, (name, value) in enumerate(values.items())
        ]
    )
    return metadata.select(F.explode(lines).alias("l")).select("l.part", "l.line")


def split_report(
    table: DataFrame, metadata: DataFrame, n_per_source: int = fv.SAMPLE_PER_SOURCE
) -> DataFrame:
    """``(section, split, part, line)``: values and counters of the mix, then each split's own report.

    Section 0 holds the values used, 1 the counters per source; 2 to 4 are those of
    ``preview_lines`` for the rows of one split. ``table`` is read for each section: store it first.
    """
    lines = metadata_lines(metadata).withColumn("section", F.lit(0)).withColumn("split", F.lit(""))
    for name in ("train", "val"):
        rows = table.where(F.col("split") == name).drop("split")
        own = preview_lines(rows, n_per_source, metadata if name == "train" else None)
        shared = F.when(F.col("section") == 1, F.lit("")).otherwise(F.lit(name))
        lines = lines.unionByName(own.withColumn("split", shared))
    return lines.select("section", "split", "part", "line")


def write_preview(lines: DataFrame, path: str) -> None:
    """One text file: the report is as long as the number of sources, not the data."""
    lines.repartitionByRange(1, "section", "part").sortWithinPartitions("section", "part").select(
        "line"
    ).write.text(path)


def write_science_items(items: DataFrame, path: str) -> None:
    """One nested item per JSON line."""
    items.select("id", "question", "answerKey").write.json(path)
