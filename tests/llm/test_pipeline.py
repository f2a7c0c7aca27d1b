"""The corpus pipeline stage by stage, on the test tables and on odd rows."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import bpe, divergence, mixing, shingles, simhash, toxicity


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_do_what_their_operators_say(spark, sf_dir, tmp_path, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), tmp_path / name)
        outputs.append(docs)
    clean, good, single, mixed, coded = outputs
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    verdicts = toxicity.toxicity(start, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(clean) == ids(verdicts.where("predicted = 0"))
    assert ids(good) == ids(divergence.quality(clean).where("kept"))
    classes = shingles.near_copies(good)
    assert ids(single) == sorted({r["component_id"] for r in classes.collect()})
    for before, after in ((start, clean), (clean, good), (good, single), (single, mixed)):
        assert after.columns == before.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(single).taken().collect() if r["taken"]}
    words = mixed.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n"))
    assert {r["doc_id"]: r["n"] for r in words.collect()} == taken
    want = sorted(
        (r["doc_id"], library.encode_ordinary(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest())
        for r in mixed.collect()
    )
    assert sorted((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in coded.collect()) == want
    final = corpus_pipeline.run(spark, sf_dir)
    lengths = sorted((d, len(t)) for d, t, _ in want)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in final.collect()) == lengths


def test_every_stage_takes_odd_rows(spark, sf_dir, tmp_path):
    text = " ".join(f"the house{i} of a garden{i} in the town{i}" for i in range(60))
    # The names of extra columns are those that stages use themselves.
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, text, None, None, None, None),
        (3, text, "en", "s", 1, "x"), (3, text, "en", "s", 1, "x"), (4, text, "en", None, 2, "x"),
        (5, "y" * 100_000, "de", "s", 3, "x"),
    ]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp string"
    )
    for name in "key nth name named row runs text_hash component tox_score kept digest src _q_text".split():
        docs = docs.withColumn(name, F.lit(1))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, table, sf_dir), tmp_path / f"{name}-{table is docs}")
            assert out.count() <= 2 * len(rows)


def test_near_copies_keep_every_text(spark):
    """A copy under a repeated id goes, another text under the same id stays."""
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = spark.createDataFrame([(1, a), (3, a), (3, b), (3, b), (None, a)], "doc_id long, text string")
    got = simhash.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in got) == [(0, "a"), (1, "a"), (3, "b")]


def test_mix_gives_each_row_what_its_source_takes(spark):
    """Equal rows of two sources, one of them null, and empty ones: words by source, not in sum."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "s"), (1, text, None), (1, text, "s"), (2, "", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    options = dict(block_words=8)
    mix = mixing.Mix(docs, **options)
    want = {r["name"]: r["n"] for r in (
        mix.stream().join(mix.sources, "src").groupBy("name").agg(F.sum("n_words").alias("n")).collect()
    )}
    got = mixing.mixed_documents(docs, **options).groupBy("source").agg(
        F.sum(mixing.size_of(F.col("text"))).alias("n")
    )
    assert {r["source"]: r["n"] for r in got.collect()} == want and set(want) == {"s", None}
