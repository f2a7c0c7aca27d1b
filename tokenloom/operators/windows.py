"""Training windows, their shuffle, and batches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import permutation_key
from tokenloom.functions.permutation import permuted_rows
from tokenloom.operators.prefix import running_total_by_key, shuffled_rank


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def shard_lengths(fragments: DataFrame) -> DataFrame:
    """``(split, shard_id, n_tokens)`` of stored fragments."""
    return fragments.groupBy("split", "shard_id").agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens")
    )


def window_index(lengths: DataFrame, window: int = fv.WINDOW_TOKENS) -> DataFrame:
    """``(split, shard_id, win, start)``: every full window with its extra target token.

    Windows never cross shards, and a shard's tail is dropped.
    """
    n = _div(F.col("n_tokens") - 1, window)
    return (
        lengths.where(n > 0)
        .select("split", "shard_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("win"))
        .withColumn("start", F.col("win") * window)
    )


def window_tokens(fragments: DataFrame, window: int = fv.WINDOW_TOKENS) -> DataFrame:
    """``(split, shard_id, win, start, tokens)`` with ``window + 1`` tokens per row.

    Windows that lie inside a fragment are cut out where it is. Only the parts at its two
    ends meet those of its neighbours by window (neighbouring windows share one token), so
    at most two parts of up to ``window`` tokens per fragment are shuffled, however long
    it is. ``fragments`` is read twice: pass stored ones.
    """
    t = F.lit(window).cast("bigint")
    pos = F.col("shard_pos")
    size = F.size("tokens").cast("bigint")
    first = _div(F.greatest(pos - 1, F.lit(0)), t)
    last = _div(pos + size - 1, t)
    first_whole, last_whole = _div(pos + t - 1, t), last - 1

    def cut(lo: Column, hi: Column) -> Column:
        return F.slice("tokens", (lo - pos + 1).cast("int"), (hi - lo).cast("int"))

    rows = fragments.where(size > 0)
    inside = rows.where(first_whole <= last_whole).select(
        "split",
        "shard_id",
        F.inline(
            F.transform(
                F.sequence(first_whole, last_whole),
                lambda win: F.struct(
                    win.alias("win"), cut(win * t, win * t + t + 1).alias("tokens")
                ),
            )
        ),
    )

    def part(win: Column) -> Column:
        lo = F.greatest(pos, win * t)
        hi = F.least(pos + size, win * t + t + 1)
        return F.struct(
            win.alias("win"), F.struct(lo.alias("at"), cut(lo, hi).alias("ids")).alias("part")
        )

    ends = F.filter(
        F.array_distinct(F.array(first, last)),
        lambda win: (win < first_whole) | (win > last_whole),
    )
    parts = rows.select("split", "shard_id", F.inline(F.transform(ends, part)))
    met = parts.groupBy("split", "shard_id", "win").agg(
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum(F.size("part.ids")).alias("n_ids"),
    )
    # Only a shard's last window can be short.
    across = met.where(F.col("n_ids") == window + 1).select(
        "split",
        "shard_id",
        "win",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("tokens"),
    )
    return inside.unionByName(across).select(
        "split", "shard_id", "win", (F.col("win") * t).alias("start"), "tokens"
    )


def shifted_pair(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Inputs ``x`` and targets ``y``: the row without its last and without its first token."""
    n = F.size(tokens) - 1
    return rows.withColumn("x", F.slice(tokens, F.lit(1), n)).withColumn(
        "y", F.slice(tokens, F.lit(2), n)
    )


def served_order(
    index: DataFrame,
    keys: tuple[str, str],
    split: str,
    *,
    seed: int = fv.SERVE_SEED,
    epoch: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``perm_pos``: shuffled per seed and epoch for training, natural order otherwise.

    Works on the narrow index only; tokens are joined to it afterwards.
    """
    rows = index.where(F.col("split") == split)
    if split == "train":
        key = permutation_key(seed, F.lit(epoch), *[F.col(k) for k in keys])
        return shuffled_rank(rows, key, out="perm_pos", buckets=buckets)
    return running_total_by_key(
        rows, F.lit(1), key=keys[0], then=[keys[1]], out="perm_pos", buckets=buckets
    )


def with_ordinal(lengths: DataFrame, window: int = fv.WINDOW_TOKENS) -> DataFrame:
    """Shards with ``first_row`` (windows of the split before it) and ``split_rows`` (all of them).

    One row per shard; with these two numbers a window knows its place without an index.
    """
    n = F.greatest(_div(F.col("n_tokens") - 1, window), F.lit(0))
    sized = lengths.withColumn("_n", n)
    placed = running_total_by_key(
        sized, F.col("_n"), key="shard_id", by=["split"], out="first_row", total="split_rows"
    )
    return placed.withColumn("first_row", F.coalesce("first_row", F.lit(0).cast("bigint"))).drop("_n")


def computed_order(rows: DataFrame, *, seed: int, epochs: Column) -> DataFrame:
    """Serving positions of ``rows`` (``row`` of ``n_rows``) in every epoch, without a sort.

    Adds ``epoch`` and ``perm_pos``: each epoch is another permutation, and a row's place
    in it is computed from the row alone, so nothing is shuffled and no index is stored.
    Rows are numbered from 0 to ``n_rows - 1``.
    """
    each = rows.withColumn("epoch", F.explode(epochs))
    place = permuted_rows(F.col("row"), F.col("n_rows"), seed, F.col("epoch"))
    return each.withColumn("perm_pos", place)


def batches(ordered: DataFrame, batch_rows: int, world: int, total: str) -> DataFrame:
    """Stripe the order over ranks and cut each stripe into full batches.

    ``total`` names a column with the number of rows in the order. Rows of an
    unfinished last batch are dropped.
    """
    pos = F.col("perm_pos")
    rank = (pos % world).cast("int")
    local = _div(pos, world)
    # Rows of rank r: positions r, r + world, ... below the total.
    of_rank = _div(F.col(total) - rank + (world - 1), world)
    return (
        ordered.withColumn("rank", rank)
        .withColumn("batch_id", _div(local, batch_rows))
        .withColumn("slot", (local % batch_rows).cast("int"))
        .where(F.col("batch_id") < _div(of_rank, batch_rows))
    )


def with_total(ordered: DataFrame, counted: DataFrame, total: str = "n_rows") -> DataFrame:
    """Attach the row count of ``counted`` as a column (a scalar subquery, not a join)."""
    return ordered.withColumn(total, counted.agg(F.count(F.lit(1))).scalar())


def epoch_of_batch(global_batch: Column, batches_per_epoch: Column) -> tuple[Column, Column]:
    """Wrap-around: which epoch and which batch in it a running batch number means."""
    return _div(global_batch, batches_per_epoch), global_batch % batches_per_epoch


def running_batch(
    epoch: Column, batch: Column, rank: Column, total: Column, batch_rows: int, world: int
) -> Column:
    """The other way round: a rank's batch number counted on through all epochs."""
    of_rank = _div(total - rank + (world - 1), world)
    return epoch * _div(of_rank, batch_rows) + batch


def next_seed(base_seed: int, split: str, new_seed: int | None = None) -> int:
    """Seed after a reset: an explicit one wins, training moves on by one, validation stays."""
    if new_seed is not None:
        return new_seed
    return base_seed + 1 if split == "train" else base_seed


def schedule(
    index: DataFrame, *, batch_rows: int, world: int, accumulation: int, epochs: int
) -> DataFrame:
    """Rows, batches, steps per epoch and total steps of each rank."""
    counts = index.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    ranks = counts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))
    of_rank = _div(F.col("n_rows") - F.col("rank") + (world - 1), world)
    return (
        ranks.withColumn("rank_rows", of_rank)
        .withColumn("rank_batches", _div(F.col("rank_rows"), batch_rows))
        .withColumn("steps_per_epoch", _div(F.col("rank_batches"), accumulation))
        .withColumn("max_steps", F.col("steps_per_epoch") * epochs)
    )


def masked_rows(rows: DataFrame) -> DataFrame:
    """Served form of encoded examples: shifted pair plus the mask of the targets."""
    return shifted_pair(rows).withColumn(
        "loss_mask", F.slice("mask", F.lit(2), F.size("mask") - 1)
    )
