"""Corpus readers. Order is explicit: every reader gives an integer ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.lookup import lookup_join
from tokenloom.operators.prefix import running_total_by_key
from tokenloom.session import materialise

CORPUS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
SAMPLE_SIZES = ("10BT", "100BT")
#: Files in a folder of text files. Spark numbers a task's files with three digits at least, so that
#: up to so many names sort like their numbers.
FOLDER_FILES = 1000


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_sized_corpus(
    spark: SparkSession, root: str, size: str = "10BT", schema: str = CORPUS_SCHEMA
) -> DataFrame:
    """One of the published sample sizes, stored as ``root/sample-<size>``."""
    if size not in SAMPLE_SIZES:
        raise ValueError(f"size has to be one of {SAMPLE_SIZES}")
    return read_corpus(spark, f"{root.rstrip('/')}/sample-{size}", schema)


def write_text_corpus(docs: DataFrame, path: str) -> None:
    """A plain text file for every ``doc_id``, whose paths sort like the ids; a null id comes last.

    Rows that share an id are lines of one file. A folder holds a thousand files: listing takes
    a step for every folder, and a folder for each file would take longer than all texts. Tasks
    move their own files into place, not the driver one by one.
    """
    line = F.coalesce(F.col("text"), F.lit(""))
    files = docs.groupBy("doc_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("bigint")
    ranked = running_total_by_key(
        files.withColumn("_key", key),
        F.lit(1),
        key="_key",
        then=["doc_id"],
        out="_place",
        bounds_from=docs.select(key.alias("_key")),
    )
    folder = F.call_function("div", F.col("_place"), F.lit(FOLDER_FILES).cast("bigint"))
    named = ranked.withColumn("of", F.lpad(folder.cast("string"), 12, "0"))
    (
        named.sortWithinPartitions("of", "_place")
        .select("of", "text")
        .write.partitionBy("of")
        .option("maxRecordsPerFile", 1)
        .option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        .text(path)
    )


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files as one document each, numbered in path order."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")
    )
    # Every file is opened once; all passes below, and the caller's, read few large ones.
    files = materialise(files, "file-texts")
    # Names alone are sorted, by ranges; the texts are joined afterwards. The ranges are
    # stored, so that both passes over them see the same ones.
    ranged = materialise(
        files.select("file_path")
        .repartitionByRange("file_path")
        .withColumn("_range", F.spark_partition_id()),
        "file-names",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("file_path")) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(starts), "_range")
    numbered = numbered.select(
        "file_path", (F.col("_start") + F.col("_place")).cast("bigint").alias("doc_id")
    )
    return files.join(numbered, "file_path").select("doc_id", "text")


def with_file_ordinal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Add ``ord`` to a Parquet table without a key: file order, then row order in the file.

    Needs one count per file; the window sees file names, not rows.
    """
    rows = spark.read.schema(schema).parquet(path)
    located = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    counts = located.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per file; the rows of a large file are not sent to one task.
    return (
        lookup_join(located, starts, ["_file"], spread_by=F.col("_row"))
        .withColumn("ord", F.col("_start") + F.col("_row"))
        .drop("_file", "_row", "_start")
    )
