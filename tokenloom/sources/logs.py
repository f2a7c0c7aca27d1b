"""Readers and writers of metric logs, metadata and reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.operators.metrics import long_from_lines, long_from_wide, rounded_log, step_times


def log_schema(columns: list[str] = fv.PRETRAIN_LOG_COLUMNS) -> str:
    return ", ".join(f"{c} {'BIGINT' if c == 'step' else 'DOUBLE'}" for c in columns)


def _file_order(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, file_order)``: files of earlier writes first, those of one write by name.

    Lists the files without reading them; one row per file reaches the driver.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect()
    names = [(r["path"].rsplit("/", 1)[-1], r["modificationTime"]) for r in listed]
    # The files of one Spark write share the id in their names.
    write_of = {n: (re.findall(r"^part-\d+-([0-9a-f-]{36})", n) or [n])[0] for n, _ in names}
    begun: dict = {}
    for name, time in names:
        begun[write_of[name]] = min(time, begun.get(write_of[name], time))
    ordered = sorted((begun[write_of[n]], write_of[n], n) for n, _ in names)
    rows = [(name, i) for i, (_, _, name) in enumerate(ordered)]
    return spark.createDataFrame(rows, "file_name string, file_order int")


def _placed(scan: DataFrame, order: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` and ``line_no``, which compares like the position in the log.

    A text scan tells the block of a file it reads but not the line. Inside one
    block the running id grows with the line, and only there is it compared.
    """
    located = scan.select(
        *columns,
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    place = F.struct("file_order", "_block", "_line").alias("line_no")
    names = [c for c in located.columns if not c.startswith("_") and c != "file_name"]
    return located.join(F.broadcast(order), "file_name").select("file_name", *names, place)


def read_wide_log(
    spark: SparkSession, path: str, run: str, columns: list[str] | None = None
) -> DataFrame:
    """Header CSV, read by the names in each file's own header; empty cells are NULL.

    Files of one log may differ in their columns and in the order of them. ``columns``
    chooses among the names; names that no file has are absent. ``line_no`` compares like
    the position in the log.
    """
    order = _file_order(spark, path)
    lines = _placed(
        spark.read.text(path), order, "value", F.col("_metadata.file_path").alias("file_path")
    )
    # One short line for every file of the log.
    headers = lines.groupBy("file_path").agg(F.min_by("value", "line_no").alias("header")).collect()
    files: dict[str, list[str]] = {}
    for row in headers:
        files.setdefault(row["header"], []).append(row["file_path"])
    parts = [
        _placed(
            spark.read.schema(log_schema([n.strip() for n in header.split(",")])).csv(
                sorted(paths), header=True, enforceSchema=False
            ),
            order,
            "*",
        ).drop("file_name")
        for header, paths in sorted(files.items())
    ]
    if not parts:
        parts = [spark.createDataFrame([], log_schema(columns or fv.PRETRAIN_LOG_COLUMNS))]
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if columns is not None:
        kept = [c for c in log.columns if c in (*columns, "line_no")]
        log = log.select(*kept)
    return log.withColumn("run", F.lit(run))


def read_line_log(spark: SparkSession, path: str, run: str) -> DataFrame:
    """``(run, line_no, line)``; ``line_no`` compares like the position in the log."""
    lines = _placed(spark.read.text(path), _file_order(spark, path), "value")
    return lines.select(F.lit(run).alias("run"), "line_no", F.col("value").alias("line"))


def read_log(
    spark: SparkSession, path: str, run: str, columns: list[str] | None = None
) -> DataFrame:
    """Long form of a log of either format; the file ending decides."""
    if path.endswith(".csv"):
        return long_from_wide(read_wide_log(spark, path, run, columns))
    return long_from_lines(read_line_log(spark, path, run))


def read_runs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b), [read_log(spark, p, run) for run, p in paths.items()]
    )


def append_log(log: DataFrame, path: str) -> None:
    """Append rows in their text form, with a header in every file."""
    rounded_log(log).write.mode("append").csv(path, header=True, emptyValue="")


def append_step_times(log: DataFrame, path: str, part: str) -> None:
    """Store the step times of one part of a log; the same part again takes its own place."""
    step_times(log).write.mode("overwrite").parquet(f"{path}/part={part}")


def read_step_times(spark: SparkSession, path: str) -> DataFrame:
    """``(run, dt_ms, n)`` over all stored parts; no log is read again."""
    parts = spark.read.schema("run STRING, dt_ms BIGINT, n BIGINT, part STRING").parquet(path)
    return parts.groupBy("run", "dt_ms").agg(F.sum("n").alias("n"))
