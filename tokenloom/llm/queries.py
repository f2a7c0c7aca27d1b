"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import (
    ann,
    bpe,
    dac,
    divergence,
    mixing,
    negatives,
    phrases,
    simhash,
    toxicity,
    unigram,
    urlfilter,
    warc,
    wrappers,
)
from tokenloom.llm.registry import CHECKS, QUERIES, query, table

__all__ = ["CHECKS", "QUERIES"]


@query(
    """
    WITH headers AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
               sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), originals AS (
        SELECT payload_digest, max(page_id) AS largest FROM headers
        WHERE payload_bytes >= 1000 GROUP BY payload_digest
    ), linked AS (
        SELECT h.*, CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
        FROM headers h LEFT JOIN originals USING (payload_digest)
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
    FROM linked
    """
)
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, equal payloads as revisits, and read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url under the rules, and under the model where no rule fits."""
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    return urlfilter.judge(table(spark, sf_dir, "pages"), model)


@query(divergence.check_sql())
def op2_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every whole text, and the verdict by distance to the references."""
    return divergence.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query()
def op10_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by the distance between its two compressed lengths."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text and the component of similar fingerprints it is in."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query()
def op6_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


@query()
def op3_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids, written in directly addressable codes and read back."""
    documents = table(spark, sf_dir, "documents")
    found = dac.round_trip(documents, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op1_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, summed over all segmentations of its words."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return unigram.identify(table(spark, sf_dir, "documents"), vocabulary)


@query()
def op5_folded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as byte-pair ids, and decoded again."""
    coded = bpe.encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query(negatives.check_sql())
def op11_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth vector, in the windows that its best same-label rows open."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query(phrases.check_sql())
def op12_shard_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to five words of every language, counted over all texts."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the wrapper inferred from all pages of its host."""
    return wrappers.extract(table(spark, sf_dir, "pages"))
