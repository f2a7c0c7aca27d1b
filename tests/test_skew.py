"""One key with most of the rows: the work is spread, the result is whole."""

from pyspark.sql import functions as F

from tokenloom.operators import convert, filters, pack, prefix, turns, windows
from tokenloom.operators.tokenizers import ByteTokenizer

BYTES = ByteTokenizer()


def share_of_fullest_task(df):
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return max(r["count"] for r in sizes) / sum(r["count"] for r in sizes)


def test_hot_source_is_spread_over_buckets(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("source"),
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("lang")).alias("skip_reason"),
    )
    ranked = prefix.running_total_by_key(
        df, F.col("skip_reason").isNull().cast("int"), key="ord", by=["source"], out="k", buckets=16
    )
    assert share_of_fullest_task(ranked) < 0.1
    capped = filters.cap_per_source(df, 5000, buckets=16)
    stats = {r["source"]: r for r in filters.skip_stats(capped).where("source IS NOT NULL").collect()}
    assert stats["hot"]["kept"] == 5000
    hot = [i for i in range(20_000) if i % 10]
    kept = [i for i in hot if i % 3]
    assert stats["hot"]["skipped_not_english"] == sum(i % 3 == 0 and i <= kept[4999] for i in hot)


def test_long_conversation_is_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(turns, "TURNS_PER_BLOCK", 64)
    n = 5000
    roles = ["assistant"] * 700 + ["system"] + ["assistant"] * 900 + ["user"] + ["system"] * 2000
    roles += ["assistant"] * (n - len(roles))
    rows = [(0, t, r, f"text {t}") for t, r in enumerate(roles)]
    rows += [(c, t, r, f"c{c} {t}") for c in range(1, 50) for t, r in enumerate(("user", "assistant"))]
    flat = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pairs = turns.first_pairs(flat, pass_over_blank=True, strip=True)
    got = {r["conv_id"]: (r["system"], r["human"], r["answer"]) for r in pairs.collect()}
    assert got[0] == ("text 700", "text 1601", "text 3602")
    assert got[7] == (None, "c7 0", "c7 1") and len(got) == 50
    nested = flat.where("conv_id = 0").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")
    )
    one = nested.select(
        F.col("conv_id").alias("ord"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias(
            "conversation"
        ),
    )
    r = convert.lmsys_chat(one).first()
    assert (r["instruction"], r["response"]) == got[0][1:]


def test_one_document_with_most_tokens(spark):
    texts = ["short"] * 40 + ["long " * 4000] + ["tail"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stream = [x for t in texts for x in [256, *t.encode()]]
    fragments = pack.shard_fragments(pack.place_documents(df, BYTES), BYTES, 1000)
    assert fragments.agg(F.max(F.size("tokens"))).first()[0] == 1000
    rows = windows.window_tokens(fragments, 64).collect()
    for r in rows:
        at = r["shard_id"] * 1000 + r["start"]
        assert r["tokens"] == stream[at : at + 65]
    assert len(rows) == sum(
        (min(1000, len(stream) - s) - 1) // 64 for s in range(0, len(stream), 1000)
    )


def test_hot_language_key_is_salted(spark):
    from tokenloom.operators.lookup import lookup_join

    left = spark.range(8000).select(F.col("id"), F.lit("the").alias("tri"))
    right = spark.createDataFrame([("the", 1.0), ("cat", 2.0)], "tri string, w double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(left, right, ["tri"], spread_by=F.col("id"), max_cells=0, salts=32)
        assert joined.count() == 8000
        assert joined.agg(F.sum("w")).first()[0] == 8000.0
        assert share_of_fullest_task(joined) < 0.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
