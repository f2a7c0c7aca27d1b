"""Token shards and example shards as partitioned Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.encode import encode_examples
from tokenloom.operators.quality import require_split, split_shards
from tokenloom.operators.tokenizers import Tokenizer

FRAGMENT_SCHEMA = (
    "shard_pos BIGINT, doc_id BIGINT, tokens ARRAY<INT>, n_piece BIGINT, split STRING, shard_id BIGINT"
)
#: A shard's directory holds its first fragment from each multiple of this position on.
MARK_TOKENS = 65_536
#: Readers of the shards pass over names with an underscore in front.
MANIFEST = "_manifest"
EXAMPLE_SCHEMA = (
    "row_id INT, source STRING, prompt_len INT, n_tokens INT, tokens ARRAY<INT>, "
    "mask ARRAY<TINYINT>, split STRING, shard_id INT"
)


def write_token_shards(fragments: DataFrame, path: str) -> None:
    """``split=/shard_id=`` folders, in stream order inside each file.

    Fragments arrive partitioned by ranges of the stream, so a task writes to few
    shards and no further shuffle is needed.
    """
    (
        fragments.withColumn("n_piece", F.size("tokens").cast("bigint"))
        .sortWithinPartitions("split", "shard_id", "shard_pos")
        .write.partitionBy("split", "shard_id")
        .parquet(path)
    )


def write_manifest(spark: SparkSession, path: str, mark_tokens: int = MARK_TOKENS) -> DataFrame:
    """Describe stored token shards, one row each, and keep that beside them.

    Reads lengths and positions of the fragments, no tokens. ``end`` is where the last
    fragment ends, and ``marks`` the directory: in order, the first fragment
    that starts in each stretch of ``mark_tokens`` positions. It holds at most one entry for
    every stretch, whatever the number of documents.
    """
    stored = spark.read.schema(FRAGMENT_SCHEMA).parquet(path)
    block = F.call_function("div", F.col("shard_pos"), F.lit(mark_tokens).cast("bigint"))
    blocks = stored.groupBy("split", "shard_id", block.alias("block")).agg(
        F.min(F.struct("shard_pos", "doc_id")).alias("mark"),
        F.sum("n_piece").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_pieces"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.max(F.col("shard_pos") + F.col("n_piece")).alias("end"),
    )
    shards = blocks.groupBy("split", "shard_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_pieces").alias("n_pieces"),
        F.min("first_doc").alias("first_doc"),
        F.max("last_doc").alias("last_doc"),
        F.max("end").alias("end"),
        F.sort_array(F.collect_list("mark")).alias("marks"),
    )
    shards.write.parquet(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def shard_faults(manifest: DataFrame, shard_tokens: int) -> DataFrame:
    """``(split, shard_id, fault)``: missing, doubled or short shards, from the manifest alone.

    Numbers run on through a stream, so that every shard but the last is full. ``torn``: tokens
    are stored twice, or fewer than its positions reach.
    """
    last = manifest.agg(F.max("shard_id").alias("last"))
    every = last.where("last IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("shard_id"), "last"
    )
    counted = manifest.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("times"),
        F.min("split").alias("split"),
        F.max("n_tokens").alias("n_tokens"),
        F.max(F.col("end") != F.col("n_tokens")).alias("torn"),
    )
    fault = (
        F.when(F.col("times").isNull(), F.lit("missing"))
        .when(F.col("times") > 1, F.lit("doubled"))
        .when(F.col("torn"), F.lit("torn"))
        .when((F.col("n_tokens") < shard_tokens) & (F.col("shard_id") < F.col("last")), F.lit("short"))
    )
    found = every.join(counted, "shard_id", "left").withColumn("fault", fault)
    return found.where("fault IS NOT NULL").select("split", "shard_id", "fault")


def locate(positions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``from_pos``, where reading has to start to meet ``(shard_id, shard_pos)``.

    Binary search in the shard's directory; the fragments that start before the next entry
    are few, however large the shard. Positions outside of the shard get NULL.
    """
    at = F.col("shard_pos")
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(24))])

    def advance(place: Column, jump: Column) -> Column:
        mark = F.try_element_at("marks", place + jump)["shard_pos"]
        return F.when(mark <= at, place + jump).otherwise(place)

    place = F.aggregate(jumps, F.lit(0), advance)
    held = manifest.select("shard_id", "marks", F.col("end").alias("_end"))
    # The fragment may begin before the stretch that holds the position: from the mark before.
    found = positions.join(held, "shard_id", "left").withColumn("_place", place)
    start = F.try_element_at("marks", F.greatest(F.col("_place"), F.lit(1)))["shard_pos"]
    return found.withColumn("from_pos", F.when((at >= 0) & (at < F.col("_end")), start)).drop(
        "marks", "_end", "_place"
    )


def fragments_at(
    positions: DataFrame, manifest: DataFrame, stored: DataFrame, mark_tokens: int = MARK_TOKENS
) -> DataFrame:
    """The fragment of every wanted position: ``(shard_id, shard_pos, doc_id, doc_offset)``.

    It starts in the same stretch as the position's directory entry, so that positions and
    fragments meet by shard and stretch; tokens are not read.
    """
    stretch = lambda at: F.call_function("div", at, F.lit(mark_tokens).cast("bigint"))
    asked = locate(positions, manifest).where("from_pos IS NOT NULL")
    asked = asked.withColumn("stretch", stretch(F.col("from_pos")))
    pieces = stored.select(
        F.col("shard_id").alias("of"), F.col("shard_pos").alias("begin"), "n_piece", "doc_id",
        stretch(F.col("shard_pos")).alias("in_stretch"),
    )
    met = asked.join(
        pieces,
        (F.col("of") == F.col("shard_id"))
        & (F.col("in_stretch") == F.col("stretch"))
        & (F.col("begin") >= F.col("from_pos"))
        & (F.col("begin") <= F.col("shard_pos"))
        & (F.col("begin") + F.col("n_piece") > F.col("shard_pos")),
    )
    return met.select(
        "shard_id", "shard_pos", "doc_id", (F.col("shard_pos") - F.col("begin")).alias("doc_offset")
    )


def read_token_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    reader = spark.read.schema(FRAGMENT_SCHEMA)
    if split is None:
        return reader.parquet(path)
    # The split's own folders alone are listed.
    try:
        rows = reader.option("basePath", path).parquet(f"{path}/split={require_split(split)}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no shards found for split {split}") from error
    return split_shards(rows, split)


def shard_name(prefix: str, split: str, shard_id: int) -> str:
    """Conventional file name of a token shard."""
    return f"{prefix}_{require_split(split)}_{shard_id:06d}"


def write_example_shards(placed: DataFrame, tokenizer: Tokenizer, path: str) -> None:
    """``split=/shard_id=`` folders; tokens, mask and source of an example share one row.

    Examples are moved to their shard as text and encoded there. Rows are stored
    unpadded; padding is added when reading.
    """
    encoded = encode_examples(placed.repartition("split", "shard_id"), tokenizer)
    (
        encoded.select(
            "split",
            "shard_id",
            "row_id",
            "source",
            "prompt_len",
            "n_tokens",
            "tokens",
            "mask",
        )
        .sortWithinPartitions("split", "shard_id", "row_id")
        .write.partitionBy("split", "shard_id")
        .parquet(path)
    )


def read_example_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(EXAMPLE_SCHEMA).parquet(path)
    return rows if split is None else split_shards(rows, split)
