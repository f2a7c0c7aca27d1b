"""Join against a table that is usually small: broadcast behind a check, salt beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_CELLS = 20_000_000
SALTS = 32


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    *,
    spread_by: Column,
    max_cells: int = BROADCAST_CELLS,
    salts: int = SALTS,
) -> DataFrame:
    """Left join that stays even when one key holds a large share of ``left``.

    ``right`` is broadcast while its rows times columns stay within ``max_cells``. A
    larger one is shuffled, with ``left`` spread over ``salts`` copies of each key so
    that no key fills a task. Columns of ``right`` have to be of fixed or short width.
    """
    max_rows = max_cells // len(right.columns)
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")
