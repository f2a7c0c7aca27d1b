"""Readers of multiple-choice benchmarks and the benchmark registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.text import py_strip
from tokenloom.operators import choices

COMPLETION_SCHEMA = (
    "ind BIGINT, activity_label STRING, ctx_a STRING, ctx_b STRING, ctx STRING, split STRING, "
    "split_type STRING, label INT, endings ARRAY<STRING>, source_id STRING"
)
SUBJECT_SCHEMA = "question STRING, a STRING, b STRING, c STRING, d STRING, answer STRING"
SCIENCE_SCHEMA = (
    "id STRING, question STRUCT<stem: STRING, choices: STRUCT<text: ARRAY<STRING>, "
    "label: ARRAY<STRING>>>, answerKey STRING"
)
SCIENCE_PAGE_SCHEMA = (
    "offset BIGINT, rows ARRAY<STRUCT<row: STRUCT<id: STRING, question: STRING, choices: "
    "STRUCT<text: ARRAY<STRING>, label: ARRAY<STRING>>, answerKey: STRING>>>"
)


def read_completion(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPLETION_SCHEMA).json(path)


def subject_csv(spark: SparkSession):
    """Reader settings for question files.

    An empty field and a missing one look alike once read, so the null marker is
    a character that no file contains.
    """
    return (
        spark.read.option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\x00")
        .option("emptyValue", "")
    )


def read_subjects(
    spark: SparkSession,
    root: str,
    split: str = "test",
    subjects: list[str] | str | None = None,
) -> DataFrame:
    """``<root>/<split>/<subject>_<split>.csv`` files, subject taken from the file name.

    A subject's file may be a folder of parts, as Spark writes it. ``None`` means the curated
    subjects, ``"all"`` every file. The file pattern and a filter on the name do the
    selection, so a subject without a file is simply absent. Rows with fewer than six
    fields are dropped; ``judged_subjects`` keeps them.
    """
    rows = judged_subjects(spark, root, split, subjects)
    return rows.where(F.col("answer").isNotNull()).drop("file", "record", "reject")


def judged_subjects(
    spark: SparkSession,
    root: str,
    split: str = "test",
    subjects: list[str] | str | None = None,
) -> DataFrame:
    """Every row of the question files with its ``file``, and why it cannot be an item.

    ``reject`` is ``fields`` for a row with fewer than six fields, ``answer`` for one whose
    answer is none of the letters, else null. ``record`` holds the text of a row that does
    not have exactly six fields. Fields beyond the sixth are ignored.
    """
    pattern = f"{root.rstrip('/')}/{split}/*_{split}.csv"
    rows = (
        subject_csv(spark)
        .schema(f"{SUBJECT_SCHEMA}, record STRING")
        .option("columnNameOfCorruptRecord", "record")
        .csv(pattern)
    )
    file = F.regexp_extract(F.col("_metadata.file_path"), f"([^/]+_{split}\\.csv)(/[^/]*)?$", 1)
    letter = py_strip(F.col("answer"))
    reject = F.when(F.col("answer").isNull(), "fields").when(
        ~letter.isin(fv.CHOICE_LETTERS), "answer"
    )
    tagged = rows.select("*", file.alias("file"), reject.alias("reject")).withColumn(
        "subject", F.regexp_extract("file", f"^(.*)_{split}\\.csv$", 1)
    )
    if subjects == "all":
        return tagged
    return tagged.where(F.col("subject").isin(subjects or fv.CURATED_SUBJECTS))


def store_judged(judged: DataFrame, path: str) -> dict[str, int]:
    """Items and rejects in two folders, and their numbers, from one scan of the files.

    ``<path>/rejected=false`` holds what ``choices.subject_items`` takes, ``rejected=true`` the
    quarantine with file, record and reason. The counters are observed while rows are written.
    """
    seen = Observation()
    counters = [F.count(F.lit(1)).alias("rows")] + [
        F.count_if(F.col("reject") == reason).alias(reason) for reason in ("fields", "answer")
    ]
    marked = judged.withColumn("rejected", F.col("reject").isNotNull()).observe(seen, *counters)
    marked.write.partitionBy("rejected").parquet(path)
    return seen.get


def with_item_ids(rows: DataFrame) -> DataFrame:
    """Number items by content where the format gives them no identity."""
    content = F.concat_ws("\x1f", "subject", "question", "a", "b", "c", "d", "answer")
    return rows.withColumn("item_id", F.md5(content))


def read_science(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCIENCE_SCHEMA).json(path)


def read_science_pages(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Stored answers of a paged service: one JSON document per file, or one per line."""
    return spark.read.schema(SCIENCE_PAGE_SCHEMA).json(path, multiLine=multi_line)


@dataclass(frozen=True)
class Benchmark:
    reader: Callable[[SparkSession, str], DataFrame]
    to_items: Callable[[DataFrame], DataFrame]
    split: str


_BENCHMARKS: dict[str, Benchmark] = {
    "hellaswag": Benchmark(read_completion, choices.completion_items, "val"),
    "mmlu": Benchmark(
        lambda spark, path: with_item_ids(read_subjects(spark, path)), choices.subject_items, "test"
    ),
    "arc": Benchmark(read_science, choices.science_items, "test"),
}


def register_benchmark(name: str, reader, to_items, split: str = "test") -> None:
    _BENCHMARKS[name] = Benchmark(reader, to_items, split)


def benchmark(name: str) -> Benchmark:
    if name not in _BENCHMARKS:
        raise ValueError(f"unknown benchmark {name!r}")
    return _BENCHMARKS[name]


def read_items(spark: SparkSession, name: str, path: str) -> DataFrame:
    chosen = benchmark(name)
    return chosen.to_items(chosen.reader(spark, path))
