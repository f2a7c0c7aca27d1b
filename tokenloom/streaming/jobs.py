"""Incremental versions of two batch tables: latest metric values and corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.metrics import long_from_wide
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.session import scratch_path


def stream_files(
    spark: SparkSession, folder: str, schema: str, *, pattern: str = "*", format: str = "parquet", **options
) -> DataFrame:
    """A file stream; every new file is picked up once."""
    reader = spark.readStream.schema(schema).format(format).option("pathGlobFilter", pattern)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def latest_values(long: DataFrame, order: str = "step") -> DataFrame:
    """Latest value and number of entries per run and stream; state is one row per stream."""
    return long.groupBy("run", "stream").agg(
        F.max_by("value", order).alias("last_value"), F.count(F.lit(1)).alias("n_entries")
    )


def latest_log_values(wide_log_stream: DataFrame) -> DataFrame:
    """The same from a growing wide log; each flush of the log has to be a new file."""
    return latest_values(long_from_wide(wide_log_stream))


def token_counts_by_source(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Documents and tokens per source so far."""
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(tokenizer.count(F.col("text")) + 1).cast("bigint").alias("n_tokens"),
    )


def run_to_table(result: DataFrame, name: str) -> DataFrame:
    """Drain what is available and return the final state of a complete-mode stream.

    Each trigger writes its own folder of the shared scratch area; the last one
    is the answer. The stream's own checkpoint lies beside it.
    """
    spark = result.sparkSession
    root = scratch_path(spark, name)
    written: list[str] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/batch-{batch_id}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    query = (
        result.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(written[-1])
