"""Registry of instruction sources: name, layout, reader, converter."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import convert

Reader = Callable[[SparkSession, str, str], DataFrame]

_MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"


def read_parquet_source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_english_only(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows in other languages never enter, so no counter sees them; the scan gets the filter."""
    return read_parquet_source(spark, path, schema).where(F.col("language") == "English")


@dataclass(frozen=True)
class Source:
    schema: str
    converter: convert.Converter
    reader: Reader = read_parquet_source


_SOURCES: dict[str, Source] = {
    "dolly": Source("ord BIGINT, instruction STRING, context STRING, response STRING", convert.dolly),
    "alpaca": Source("ord BIGINT, instruction STRING, input STRING, output STRING", convert.alpaca),
    "smol-smoltalk": Source(f"ord BIGINT, messages {_MESSAGES}", convert.smol_smoltalk),
    "tulu3": Source(f"ord BIGINT, messages {_MESSAGES}", convert.tulu3),
    "guanaco": Source("ord BIGINT, text STRING", convert.guanaco),
    "openorca": Source(
        "ord BIGINT, instruction STRING, system STRING, response STRING", convert.openorca
    ),
    "slimorca": Source(
        "ord BIGINT, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>", convert.slimorca
    ),
    "gsm8k": Source("ord BIGINT, question STRING, answer STRING", convert.gsm8k),
    "lmsys-chat": Source(
        f"ord BIGINT, conversation {_MESSAGES}, language STRING",
        convert.lmsys_chat,
        read_english_only,
    ),
    "open-platypus": Source(
        "ord BIGINT, instruction STRING, input STRING, output STRING", convert.open_platypus
    ),
}


def source_names() -> list[str]:
    return list(_SOURCES)


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known are {', '.join(_SOURCES)}")
    return _SOURCES[name]


def register_source(
    name: str, schema: str, converter: convert.Converter, reader: Reader = read_parquet_source
) -> None:
    """Add a source; the converter gives ``ord`` and the unified columns."""
    _SOURCES[name] = Source(schema, converter, reader)


def unified_mix(raw: dict[str, DataFrame]) -> DataFrame:
    """Convert each raw table with its own converter and put all examples together."""
    parts = [source(name).converter(df) for name, df in raw.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_mix(
    spark: SparkSession, paths: dict[str, str], names: Iterable[str] | None = None
) -> DataFrame:
    """Read and convert the named sources (default: all that have a path)."""
    chosen = list(names) if names is not None else list(paths)
    return unified_mix(
        {n: source(n).reader(spark, paths[n], source(n).schema) for n in chosen}
    )
