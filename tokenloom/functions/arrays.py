"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may copy a projected expression into each place that refers to it,
    lambda bodies included, where it would run once per element. A lambda
    variable is evaluated exactly once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluated_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Select ``keep`` and the new columns so that each new one is computed once per row.

    A later filter on an ordinary projected column is moved below the projection
    and repeats its expression at every use. It cannot move below a generator, so
    the columns leave through one that yields exactly one row.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))


def utf8_ids(c: Column) -> Column:
    """UTF-8 bytes of a text as integers 0-255, a batch of texts at a time."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.cast(pa.binary())
            # The bytes lie one after another; the lists keep the texts' bounds.
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
            held = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
            yield pa.ListArray.from_arrays(
                pa.array(bounds - bounds[0]),
                pa.array(held.astype(np.int32)),
                mask=texts.is_null() if texts.null_count else None,
            )

    return run(c.cast("string"))


def digest(ids: Column) -> Column:
    """md5 over the comma-joined integers: a comparable stand-in for an array. Nulls are left out."""
    listed = F.to_json(ids)  # written in one pass, no string for each element
    joined = F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.md5(
        F.when(listed.contains("null"), F.array_join(ids.cast("array<string>"), ",")).otherwise(joined)
    )


def trailing_run(ids: Column, value: int) -> Column:
    """Length of the run of ``value`` that ends the array."""
    return let(
        F.array_position(F.transform(F.reverse(ids), lambda t: t != value), True),
        lambda p: F.when(p == 0, F.size(ids)).otherwise((p - 1).cast("int")),
    )


def permutation_key(seed: int | Column, *parts: Column) -> Column:
    """Order by this to shuffle: the same seed always gives the same permutation."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("-", head.cast("string"), *[p.cast("string") for p in parts]))
