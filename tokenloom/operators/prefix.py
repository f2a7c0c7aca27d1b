"""Running totals and ranks over a whole table, without a single-task window.

``sum() over (order by key)`` sends every row to one task. Here each row first
gets a bucket number that grows with the key and depends on nothing but the row
itself, so both passes below agree even when tasks are lost and run again:

1. sum the value per bucket (partial aggregation, one small row per bucket) and
   turn these sums into what each bucket starts from;
2. send that start into its bucket as one extra row in front of all others and
   run an ordinary window inside each bucket.

The start travels as a row of the same shuffle, so nothing is broadcast and no
size has to be known, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import default_buckets

KEYS_PER_BUCKET = 100

_VALUE, _BUCKET, _BODY, _TOTAL = "_rt_value", "_rt_bucket", "_rt_body", "_rt_total"


def _constant_array(values: Sequence[float], element: str) -> Column:
    """Many numbers as one text literal, which Spark folds into a constant array."""
    text = ",".join(str(v) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{element}>")


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Upper bounds that cut an integer key into buckets of similar row counts.

    Works on the key column alone, and on a sample of it once there are far more
    rows than buckets, as Spark's own range partitioner does. The bounds decide how
    even the buckets are, never what the result is. ``buckets - 1`` numbers reach
    the driver.
    """
    if buckets <= 1:
        return []
    keys = df.select(key)
    enough = KEYS_PER_BUCKET * buckets
    n = keys.count()
    if n > 2 * enough:
        keys = keys.sample(enough / n, seed=0)
    shares = _constant_array([i / buckets for i in range(1, buckets)], "double")
    cut = F.percentile_approx(key, shares, max(10_000, 4 * buckets))
    found = keys.agg(cut.alias("bounds")).first()["bounds"]
    return sorted(set(found or []))


def range_bucket(key: Column, bounds: Sequence[int]) -> Column:
    """Bucket of an integer key: binary search in the bounds, log2 steps per row."""
    if not bounds:
        return F.lit(0)
    sorted_bounds = _constant_array(bounds, "bigint")
    halvings = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    jumps = F.array(*[F.lit(j) for j in halvings])

    def advance(at: Column, jump: Column) -> Column:
        # try_element_at is 1-based: element at+jump is the last bound the jump passes.
        return F.when(F.try_element_at(sorted_bounds, at + jump) < key, at + jump).otherwise(at)

    return F.aggregate(jumps, F.lit(0), advance)


def hash_bucket(md5_hex: Column, buckets: int) -> Column:
    """Bucket of an md5 key from its first 32 bits; order-preserving and even."""
    head = F.conv(F.substring(md5_hex, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(head * F.lit(buckets).cast("bigint"), 32).cast("int")


def running_total(
    df: DataFrame,
    value: Column,
    *,
    order_by: Sequence[str],
    bucket: Column,
    buckets: int,
    by: Sequence[str] = (),
    out: str = "start",
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows (of the same ``by`` group).

    ``order_by`` has to be unique within a group, and ``bucket`` must never
    decrease along it. ``total`` names an optional column for the group's sum.
    The result stays partitioned by bucket, that is by ranges of the order.
    """
    by, order_by = list(by), list(order_by)
    body = df.withColumn(_VALUE, value.cast("bigint")).withColumn(_BUCKET, bucket.cast("int"))

    sums = body.groupBy(*by, _BUCKET).agg(F.sum(_VALUE).alias(_VALUE))
    group = Window.partitionBy(*by)
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket and group, so these windows see bucket counts, never data.
    carry = sums.select(
        *by,
        _BUCKET,
        F.coalesce(F.sum(_VALUE).over(before), F.lit(0)).alias(_VALUE),
        F.sum(_VALUE).over(group).alias(_TOTAL),
        F.lit(0).alias(_BODY),
    )

    rows = (
        body.withColumn(_TOTAL, F.lit(None).cast("bigint"))
        .withColumn(_BODY, F.lit(1))
        .unionByName(carry, allowMissingColumns=True)
        .repartitionById(buckets, F.col(_BUCKET))
    )
    so_far = (
        Window.partitionBy(_BUCKET, *by)
        .orderBy(_BODY, *order_by)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    result = rows.withColumn(out, F.sum(_VALUE).over(so_far))
    if total:
        result = result.withColumn(total, F.first(_TOTAL, ignorenulls=True).over(so_far))
    return result.where(F.col(_BODY) == 1).drop(_VALUE, _BUCKET, _BODY, _TOTAL)


def running_total_by_key(
    df: DataFrame,
    value: Column,
    *,
    key: str,
    by: Sequence[str] = (),
    then: Sequence[str] = (),
    out: str = "start",
    total: str | None = None,
    bounds_from: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Running total along an integer key; ``then`` breaks ties within equal keys.

    ``bounds_from`` may name a cheaper table holding the same keys.
    """
    wanted = buckets or default_buckets(bounds_from if bounds_from is not None else df)
    bounds = range_bounds(bounds_from if bounds_from is not None else df, key, wanted)
    return running_total(
        df,
        value,
        order_by=[key, *then],
        bucket=range_bucket(F.col(key), bounds),
        buckets=len(bounds) + 1,
        by=by,
        out=out,
        total=total,
    )


def shuffled_rank(
    df: DataFrame,
    md5_key: Column,
    *,
    by: Sequence[str] = (),
    out: str = "rank",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """0-based position of every row in the order of its md5 key."""
    wanted = buckets or default_buckets(df)
    keyed = df.withColumn("_rank_key", md5_key)
    return running_total(
        keyed,
        F.lit(1),
        order_by=["_rank_key"],
        bucket=hash_bucket(F.col("_rank_key"), wanted),
        buckets=wanted,
        by=by,
        out=out,
        total=total,
    ).drop("_rank_key")
