"""Pack documents into one token stream and cut it into fixed-size shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import let
from tokenloom.operators.prefix import running_total_by_key
from tokenloom.operators.tokenizers import Tokenizer, checked_ids, with_leading_delimiter
from tokenloom.session import materialise


def tokenise_corpus(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Add ``tokens`` (delimiter first) and ``n_tokens``."""
    return docs.withColumn(
        "tokens", checked_ids(with_leading_delimiter(tokenizer, F.col(text)))
    ).withColumn("n_tokens", F.size("tokens"))


def place_documents(
    docs: DataFrame,
    tokenizer: Tokenizer,
    *,
    order: str = "doc_id",
    text: str = "text",
    n_tokens: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``n_tokens``, ``start`` (position of the delimiter in the stream) and ``stream_tokens``.

    Only the text is shuffled; its token array, several times larger, is made
    afterwards. A tokenizer that needs Python runs once, and its output is kept.
    Pass ``n_tokens`` (delimiter included) when the table stores it: the pass that
    sums sizes then reads that column instead of the texts. A NULL text is empty.
    """
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    if tokenizer.native and n_tokens is not None:
        sized = docs.withColumn("n_tokens", n_tokens)
    elif tokenizer.native:
        sized = docs.withColumn("n_tokens", tokenizer.count(F.col(text)) + 1)
    else:
        sized = materialise(tokenise_corpus(docs, tokenizer, text).drop(text), "tokenised")
    return running_total_by_key(
        sized,
        F.col("n_tokens"),
        key=order,
        bounds_from=docs,
        total="stream_tokens",
        buckets=buckets,
    )


def within(placed: DataFrame, end: int, begin: int = 0) -> DataFrame:
    """The documents that touch stream positions ``begin`` to ``end - 1``.

    Positions come from lengths, so this stands in front of tokenising: texts outside
    of the range are neither tokenised nor moved on.
    """
    return placed.where(
        (F.col("start") < F.lit(end)) & (F.col("start") + F.col("n_tokens") > F.lit(begin))
    )


def two_way_split(placed: DataFrame, tokenizer: Tokenizer, share: float = 0.9) -> DataFrame:
    """A placed stream as one training and one validation shard: the first ``share`` of its tokens trains.

    Rows are ``(split, shard_id, shard_pos, doc_id, tokens)``, ready to be stored. The document
    at the boundary is cut in two; the boundary travels with the rows as ``stream_tokens``.
    """
    cut = F.floor(F.col("stream_tokens") * F.lit(float(share))).cast("bigint")
    begin, end = F.col("start"), F.col("start") + F.col("n_tokens")
    parts = F.array(
        F.struct(F.lit("train").alias("split"), begin.alias("lo"), F.least(end, cut).alias("hi"), F.lit(0).cast("bigint").alias("base")),
        F.struct(F.lit("val").alias("split"), F.greatest(begin, cut).alias("lo"), end.alias("hi"), cut.alias("base")),
    )
    cells = placed.select("*", F.explode(F.filter(parts, lambda p: p["lo"] < p["hi"])).alias("part"))
    if "tokens" not in cells.columns:
        cells = tokenise_corpus(cells, tokenizer)
    first = (F.col("part.lo") - F.col("start") + 1).cast("int")
    width = (F.col("part.hi") - F.col("part.lo")).cast("int")
    return cells.select(
        "part.split",
        F.lit(0).cast("bigint").alias("shard_id"),
        (F.col("part.lo") - F.col("part.base")).alias("shard_pos"),
        "doc_id",
        F.slice("tokens", first, width).alias("tokens"),
    )


def split_of_shard(shard_id: Column) -> Column:
    """The first shard is held out; a stream of one shard has no training part."""
    return F.when(shard_id == 0, F.lit("val")).otherwise(F.lit("train"))


def shard_pieces(placed: DataFrame, shard_tokens: int = fv.SHARD_TOKENS) -> DataFrame:
    """One row per document and shard it touches: position and length, no tokens."""
    size = F.lit(shard_tokens).cast("bigint")
    end = F.col("start") + F.col("n_tokens")
    first, last = F.call_function("div", F.col("start"), size), F.call_function("div", end - 1, size)
    pieces = placed.withColumn("shard_id", F.explode(F.sequence(first, last)))
    base = F.col("shard_id") * size
    return (
        pieces.withColumn("shard_pos", F.greatest(F.col("start") - base, F.lit(0)))
        .withColumn("doc_pos", F.greatest(base - F.col("start"), F.lit(0)))
        .withColumn(
            "n_piece", F.least(end, base + size) - F.greatest(F.col("start"), base)
        )
        .withColumn("split", split_of_shard(F.col("shard_id")))
    )


def shard_fragments(
    placed: DataFrame,
    tokenizer: Tokenizer,
    shard_tokens: int = fv.SHARD_TOKENS,
    text: str = "text",
) -> DataFrame:
    """``(split, shard_id, shard_pos, doc_id, tokens)``; no row exceeds one document or shard.

    Slices are cut inside one array expression per document, so a long document
    is tokenised once and copied once, however many shards it spans.
    """
    size = F.lit(shard_tokens).cast("bigint")
    end = F.col("start") + F.col("n_tokens")
    shards = F.sequence(
        F.call_function("div", F.col("start"), size), F.call_function("div", end - 1, size)
    )
    ids = (
        F.col("tokens")
        if "tokens" in placed.columns
        else checked_ids(with_leading_delimiter(tokenizer, F.col(text)))
    )

    def cut(tokens: Column) -> Column:
        def piece(shard: Column) -> Column:
            lo = F.greatest(F.col("start"), shard * size)
            hi = F.least(end, (shard + 1) * size)
            return F.struct(
                shard.alias("shard_id"),
                (lo - shard * size).alias("shard_pos"),
                F.slice(
                    tokens, (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")
                ).alias("tokens"),
            )

        return F.transform(shards, piece)

    return placed.select("doc_id", F.inline(let(ids, cut))).select(
        split_of_shard(F.col("shard_id")).alias("split"),
        "shard_id",
        "shard_pos",
        "doc_id",
        "tokens",
    )


def shard_summary(pieces: DataFrame) -> DataFrame:
    """Tokens, pieces and documents that start in each shard."""
    return pieces.groupBy("split", "shard_id").agg(
        F.sum("n_piece").cast("bigint").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_pieces"),
        F.count_if(F.col("doc_pos") == 0).alias("n_docs_started"),
    )


def contiguous_split(
    placed: DataFrame, train_fraction: float = fv.CONTIGUOUS_TRAIN_FRACTION
) -> DataFrame:
    """Cut the stream once: the first share of its tokens trains, the rest validates.

    Returns the documents' pieces ``(split, doc_id, split_pos, doc_pos, n_piece)``.
    """
    cut = F.floor(F.col("stream_tokens") * F.lit(float(train_fraction))).cast("bigint")
    end = F.col("start") + F.col("n_tokens")
    parts = F.array(
        F.struct(
            F.lit("train").alias("split"),
            F.col("start").alias("split_pos"),
            F.lit(0).cast("bigint").alias("doc_pos"),
            (F.least(end, cut) - F.col("start")).cast("bigint").alias("n_piece"),
        ),
        F.struct(
            F.lit("val").alias("split"),
            F.greatest(F.col("start") - cut, F.lit(0)).alias("split_pos"),
            F.greatest(cut - F.col("start"), F.lit(0)).alias("doc_pos"),
            (end - F.greatest(F.col("start"), cut)).cast("bigint").alias("n_piece"),
        ),
    )
    return placed.select("doc_id", F.inline(parts)).where("n_piece > 0")


def corpus_size(
    docs: DataFrame, tokenizer: Tokenizer, batch_tokens: int, by: str = "source"
) -> DataFrame:
    """Documents, tokens and steps per epoch, per ``by`` value and in total (NULL row)."""
    sized = docs.select(by, (tokenizer.count(F.col("text")) + 1).alias("n_tokens"))
    return (
        sized.rollup(by)
        .agg(
            F.grouping(by).cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n_tokens").cast("bigint").alias("n_tokens"),
        )
        .withColumn(
            "steps_per_epoch",
            F.call_function("div", F.col("n_tokens"), F.lit(batch_tokens).cast("bigint")),
        )
    )
