"""Mixing sources to target weights, in blocks of fixed length.

The words of a source, its documents in the order of their ids, are one stream that is
cut into blocks. A source's target fixes how many blocks the mix takes from it. How many
of them an output shard gets is drawn: a multinomial draw per shard, conditional on the
sources' totals, by halving the range of shards, so that every shard finds its own counts
and offsets in a few steps and no plan of all shards exists anywhere. Slot numbers of a
source go through a pseudorandom permutation of its block indexes, a new one for every
pass, and the blocks are joined by index.

Draws and permutations depend on the seed alone: reruns and lost tasks give the same mix.
A block is taken once more per full pass, so no document exceeds the cap on its source.

A null or empty text has size 0 and is never taken; a null source is a source of its own,
the last one. Rows without an id come first in their source. Repeated rows are separate
stretches of the stream. An empty table, or one without words, has targets of 0. Sources
are one row each on the driver and in a broadcast, whatever the number of documents; slots,
which Spark takes for as few as their shards, are joined by a sort merge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.prefix import running_total_by_key
from tokenloom.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 128
#: Rows of a batch that are held as Python texts at once.
SLICE_ROWS = 256
SHARD_SLOTS = 4096
SEED = 17
#: Above so many slots a range of shards is halved in proportion instead of by a draw.
DRAWN = 10**9

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS) -> list[float]:
    """Words to take from each source, sources in order.

    ``SHARE`` of all sizes is divided by weight; what exceeds ``CAP`` times a source's
    size is divided again among the others until none is above.
    """
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        left = SHARE * sum(sizes) - sum(fixed.values())
        total = sum(w for i, w in enumerate(weight) if i not in fixed)
        share = {i: left * w / total for i, w in enumerate(weight) if i not in fixed}
        above = {i: float(CAP * sizes[i]) for i, t in share.items() if t > CAP * sizes[i]}
        if not above:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= above


def block_quotas(
    sizes: Sequence[int], wanted: Sequence[float], block_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source, and how many block draws come closest to its target."""
    blocks = np.array([-(-s // block_words) for s in sizes], dtype=np.int64)
    draws = [
        min(CAP * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, wanted, blocks.tolist())
    ]
    return blocks, np.array(draws, dtype=np.int64)


def shard_counts(
    shard: int, shards: int, quotas: np.ndarray, slots: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """A shard's number of draws from every source, and its first draw number in each.

    All shards together use every quota exactly.
    """
    low, high, node = 0, shards, 1
    counts, first = quotas.copy(), np.zeros_like(quotas)
    while high - low > 1:
        middle = (low + high) // 2
        total = int(counts.sum())
        take = min(total, (middle - low) * slots)
        if total >= DRAWN:
            exact = counts * (take / total)
            left = np.minimum(np.floor(exact).astype(np.int64), counts)
            order = np.argsort(-(exact - left), kind="stable")
            for i in np.resize(order, max(0, take - int(left.sum()))):
                left[i] += left[i] < counts[i]
        else:
            rng = np.random.default_rng([seed, node])
            left = rng.multivariate_hypergeometric(counts, take, method="marginals")
        if shard < middle:
            counts, high, node = left, middle, 2 * node
        else:
            counts, first, low, node = counts - left, first + left, middle, 2 * node + 1
    return counts, first


def permuted(index: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """Image of each index under a pseudorandom permutation of ``range(n)``.

    A four-round Feistel network over the next even power of two; images outside of the
    range walk on along their cycle until they fall inside.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    round_keys = np.random.SeedSequence(list(keys)).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in round_keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slots_of_shard(
    shard: int, shards: int, blocks: np.ndarray, quotas: np.ndarray, slots: int, seed: int
) -> dict[str, np.ndarray]:
    """Source number, pass and block index of every slot of one output shard."""
    counts, first = shard_counts(shard, shards, quotas, slots, seed)
    src, turn, block = [], [], []
    for s in np.nonzero(counts)[0].tolist():
        draws = np.arange(first[s], first[s] + counts[s])
        passes, at = draws // blocks[s], draws % blocks[s]
        image = np.empty_like(at)
        for p in np.unique(passes).tolist():
            chosen = passes == p
            image[chosen] = permuted(at[chosen], int(blocks[s]), (seed, s, p))
        src.append(np.full(len(draws), s))
        turn.append(passes)
        block.append(image)
    n = int(counts.sum())
    order = np.random.default_rng([seed, shard, 1]).permutation(n)
    cells = {"src": src, "turn": turn, "block": block}
    out = {k: np.concatenate(v)[order] if v else np.zeros(0, np.int64) for k, v in cells.items()}
    return {"shard": np.full(n, shard), "slot": np.arange(n)} | out


class Mix:
    """Sources, their targets and the placement of all documents in their streams."""

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = WEIGHTS,
        block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS,
        seed: int = SEED,
    ):
        self.spark, self.block_words, self.shard_slots, self.seed = (
            docs.sparkSession, block_words, shard_slots, seed,
        )
        sized = materialise(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.col("source").cast("string").alias("source"),
                size_of(F.col("text")).alias("size"),
                F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"),
            ),
            "mix-sizes",
        )
        rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.sizes = [r["size"] for r in rows]
        self.targets = targets(self.sizes, weights) if rows else []
        self.blocks, self.quotas = block_quotas(self.sizes, self.targets, block_words)
        self.sources = sources = self.spark.createDataFrame(
            [(r["source"], i, r["size"], t) for i, (r, t) in enumerate(zip(rows, self.targets))],
            "name string, src int, source_size long, target double",
        )
        numbered = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["name"]))
        placed = running_total_by_key(
            numbered.drop("name", "source"), F.col("size"), key="doc_id", by=["src"],
            then=["size", "key"], out="start", bounds_from=sized,
        )
        self.placed = materialise(
            placed.withColumn("start", F.coalesce("start", F.lit(0).cast("long"))), "mix-placed"
        )

    def slots(self) -> DataFrame:
        """``(shard, slot, src, turn, block)`` of the whole mix."""
        blocks, quotas = self.blocks, self.quotas
        slots, seed = self.shard_slots, self.seed
        shards = max(1, -(-int(quotas.sum()) // slots)) if len(quotas) else 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"].tolist():
                    yield pd.DataFrame(slots_of_shard(shard, shards, blocks, quotas, slots, seed))

        return self.spark.range(shards).mapInPandas(
            run, "shard long, slot long, src int, turn long, block long"
        )

    def fragments(self) -> DataFrame:
        """``(src, start, doc_id, block, first_word, n_words)``: documents cut at block bounds."""
        width = F.lit(self.block_words).cast("long")
        ends = F.col("start") + F.col("size")
        cut = self.placed.where("size > 0").withColumn(
            "block",
            F.explode(
                F.sequence(F.floor(F.col("start") / width), F.floor((ends - 1) / width))
            ),
        )
        begin = F.greatest(F.col("start"), F.col("block") * width)
        stop = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width)
        return cut.select(
            "src", "start", "doc_id", "key", "block",
            (begin - F.col("start")).alias("first_word"), (stop - begin).alias("n_words"),
        )

    def stream(self) -> DataFrame:
        """The mix itself: every slot with the document fragments of its block."""
        return self.slots().hint("merge").join(self.fragments(), ["src", "block"])

    def taken(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken)`` of every document."""
        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        words = (
            self.fragments()
            .join(times.hint("merge"), ["src", "block"])
            .groupBy("src", "start")
            .agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        )
        full = self.placed.where("size > 0").join(words, ["src", "start"], "left")
        none = self.placed.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
        return full.unionByName(none).select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        )


def _cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The stretches of a text that hold the given word ranges, one under the other."""
    spans = [m.span() for m in WORD.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[a + n - 1][1]] for a, n in ranges)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of the same columns: per pass, what the mix takes of each document.

    ``text`` becomes the words taken in that pass, ``n_chars``, where present, their length.
    """
    mix = Mix(docs, **options)
    # Rows equal in id, source and text are told apart by number, in any order.
    nth = F.row_number().over(Window.partitionBy("key", "src").orderBy("start"))
    places = mix.placed.where("size > 0").select("src", "start", nth.alias("nth"))
    runs = (
        mix.stream()
        .groupBy("src", "start", "key", "turn")
        # At most one entry for every block that the document touches.
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
        .join(places, ["src", "start"])
        .join(F.broadcast(mix.sources.select("src", "name")), "src")
        .select("key", "name", "nth", "runs")
    )
    # The whole row in one column, so that no name of its own can clash.
    keyed = docs.where(size_of(F.col("text")) > 0).select(
        F.struct(*docs.columns).alias("row"),
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"),
        F.col("source").cast("string").alias("named"),
    )
    row = Window.partitionBy("key", "named").orderBy(F.lit(0))
    keyed = keyed.withColumn("nth", F.row_number().over(row))
    joined = keyed.join(runs, ["key", "nth"]).where(F.col("named").eqNullSafe(F.col("name")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                columns = list(part.column(0).flatten())
                texts = [
                    _cut_words(t.as_py(), merged(r.as_py()))
                    for t, r in zip(columns[at], part.column(1))
                ]
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    i = names.index("n_chars")
                    columns[i] = pa.array([len(t) for t in texts]).cast(columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select("row", "runs").mapInArrow(run, docs.schema)


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Neighbouring word ranges in one."""
    out: list[tuple[int, int]] = []
    for r in runs:
        if out and sum(out[-1]) == r["first_word"]:
            out[-1] = (out[-1][0], out[-1][1] + r["n_words"])
        else:
            out.append((r["first_word"], r["n_words"]))
    return out
