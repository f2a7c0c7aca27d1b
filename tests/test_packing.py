"""Running totals, packing, windows, batches and tokenizers against plain Python."""

import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom import session
from tokenloom.functions.arrays import digest
from tokenloom.operators import pack, prefix, windows
from tokenloom.operators.tokenizers import (
    ByteTokenizer,
    RankFileTokenizer,
    checked_ids,
    with_leading_delimiter,
)
from tokenloom.sources import corpus, shards

BYTES = ByteTokenizer()
TEXTS = ["", "a", "aé\x00中😀", "x" * 57, "\n\n", "tail", "ünï", "b" * 23, "<|endoftext|>"]


def docs(spark, texts, partitions=3):
    rows = [(i * 7 - 3, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)


def stream_of(texts):
    return [x for t in texts for x in [256, *t.encode()]]


@pytest.mark.parametrize("buckets", [1, 4, 17])
@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_running_total_does_not_depend_on_partitioning(spark, buckets, partitions):
    rows = [(g, k * 3 + 1, (k * 13) % 5) for g in ("a", "b") for k in range(60 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(partitions)
    got = prefix.running_total_by_key(
        df, F.col("v"), key="k", by=["g"], buckets=buckets, total="all"
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [v for g, k, v in rows if g == r["g"] and k < r["k"]]
        assert r["start"] == sum(earlier)
        assert r["all"] == sum(v for g, _, v in rows if g == r["g"])


def test_one_key_range_may_hold_most_rows(spark):
    """Two thirds of all keys lie in a narrow range; buckets still get similar shares."""
    keys = list(range(1_000_000, 1_002_000)) + [i * 10_000_000 for i in range(1, 1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    bounds = prefix.range_bounds(df, "k", 16)
    sizes = df.groupBy(prefix.range_bucket(F.col("k"), bounds).alias("b")).count().collect()
    assert len(sizes) == 16
    assert max(r["count"] for r in sizes) < 2 * len(keys) / 16


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=30, unique=True), st.integers(1, 9))
def test_range_bucket_is_a_sorted_search(spark, keys, n):
    import bisect

    bounds = sorted(set(keys))[:n]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = df.select("k", prefix.range_bucket(F.col("k"), bounds).alias("b")).collect()
    assert all(r["b"] == bisect.bisect_left(bounds, r["k"]) for r in got)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack.shard_summary(pack.shard_pieces(pack.place_documents(empty, BYTES), 10)).count() == 0


def test_hash_bucket_keeps_the_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    rows = df.select("h", prefix.hash_bucket(F.col("h"), 13).alias("b")).orderBy("h").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets) and set(buckets) == set(range(13))


def test_stored_sizes_and_null_texts(spark):
    rows = [(0, "ab", 3), (1, None, 1), (2, "c", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    by_size = pack.place_documents(df, BYTES, n_tokens=F.col("n"))
    plain = pack.place_documents(df.drop("n"), BYTES)
    want = {0: 0, 1: 3, 2: 4}
    assert {r["doc_id"]: r["start"] for r in by_size.collect()} == want
    assert {r["doc_id"]: r["start"] for r in plain.collect()} == want
    pieces = pack.shard_fragments(plain, BYTES, 100).orderBy("doc_id").collect()
    assert [r["tokens"] for r in pieces] == [[256, 97, 98], [256], [256, 99]]


def test_known_packing(spark):
    """Documents of 4, 6, 7 and 1 tokens in shards of 10, and one of 25 over three shards."""
    df = docs(spark, ["abc", "abcde", "abcdef", ""])
    got = pack.shard_summary(pack.shard_pieces(pack.place_documents(df, BYTES), 10)).collect()
    assert sorted((r["split"], r["shard_id"], r["n_tokens"], r["n_docs_started"]) for r in got) == [
        ("train", 1, 8, 2),
        ("val", 0, 10, 2),
    ]
    long = pack.place_documents(docs(spark, ["x" * 24]), BYTES)
    assert sorted(r["n_piece"] for r in pack.shard_pieces(long, 10).collect()) == [5, 10, 10]
    full = pack.place_documents(docs(spark, ["x" * 9, "x" * 9]), BYTES)
    assert pack.shard_pieces(full, 10).select("shard_id").distinct().count() == 2


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
@pytest.mark.parametrize("buckets", [1, 5])
def test_fragments_conserve_the_stream(spark, size, buckets):
    placed = pack.place_documents(docs(spark, TEXTS), BYTES, buckets=buckets)
    rows = pack.shard_fragments(placed, BYTES, size).collect()
    rebuilt = [t for r in sorted(rows, key=lambda r: (r["shard_id"], r["shard_pos"])) for t in r["tokens"]]
    assert rebuilt == stream_of(TEXTS)
    lengths = {}
    for r in rows:
        lengths[r["shard_id"]] = lengths.get(r["shard_id"], 0) + len(r["tokens"])
    assert all(n == size for s, n in lengths.items() if s != max(lengths))
    assert {r["split"] for r in rows if r["shard_id"] == 0} == {"val"}


@pytest.mark.parametrize("size, window", [(50, 4), (64, 7), (1000, 16), (5, 4), (4, 4)])
def test_windows_are_slices_of_their_shard(spark, size, window):
    stream = stream_of(TEXTS)
    parts = [stream[i : i + size] for i in range(0, len(stream), size)]
    want = {
        (s, w): part[w * window : w * window + window + 1]
        for s, part in enumerate(parts)
        for w in range((len(part) - 1) // window)
    }
    placed = pack.place_documents(docs(spark, TEXTS), BYTES)
    fragments = pack.shard_fragments(placed, BYTES, size)
    rows = windows.shifted_pair(windows.window_tokens(fragments, window)).collect()
    assert {(r["shard_id"], r["win"]): r["tokens"] for r in rows} == want
    assert all(r["x"] == r["tokens"][:-1] and r["y"] == r["tokens"][1:] for r in rows)
    index = windows.window_index(windows.shard_lengths(fragments), window).collect()
    assert {(r["shard_id"], r["win"]) for r in index} == set(want)
    assert all(r["start"] == r["win"] * window for r in index)


@pytest.mark.parametrize("n, window, want", [(9, 4, 2), (8, 4, 1), (5, 4, 1), (4, 4, 0), (0, 4, 0)])
def test_window_counts(spark, n, window, want):
    lengths = spark.createDataFrame([("val", 0, n)], "split string, shard_id bigint, n_tokens bigint")
    assert windows.window_index(lengths, window).count() == want


def test_every_row_is_served_once_or_in_the_tail(spark):
    index = spark.range(7).select(F.lit("train").alias("split"), F.lit(0).alias("shard_id"), F.col("id").alias("win"))
    order = windows.with_total(windows.served_order(index, ("shard_id", "win"), "train"), index)
    rows = windows.batches(order, 2, 2, "n_rows").collect()
    assert sorted((r["rank"], r["batch_id"], r["slot"]) for r in rows) == [
        (0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1),
    ]
    assert len({r["win"] for r in rows}) == 6
    positions = {r["win"]: r["perm_pos"] for r in order.collect()}
    assert sorted(positions.values()) == list(range(7))
    again = windows.served_order(index, ("shard_id", "win"), "train", seed=windows.next_seed(1337, "train"))
    assert {r["win"]: r["perm_pos"] for r in again.collect()} != positions


def test_reset_seed():
    assert windows.next_seed(5, "train") == 6
    assert windows.next_seed(5, "val") == 5
    assert windows.next_seed(5, "val", 9) == 9


def test_contiguous_split(spark):
    total = len(stream_of(TEXTS))
    rows = pack.contiguous_split(pack.place_documents(docs(spark, TEXTS), BYTES)).collect()
    sizes = {s: sum(r["n_piece"] for r in rows if r["split"] == s) for s in ("train", "val")}
    assert sizes == {"train": int(total * 0.9), "val": total - int(total * 0.9)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=20))
def test_bytes_round_trip(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ids = BYTES.encode(F.col("t"))
    rows = df.select("i", ids.alias("e"), BYTES.count(F.col("t")).alias("n"), BYTES.decode(ids).alias("d"))
    for r in rows.collect():
        assert r["e"] == list(texts[r["i"]].encode()) and r["n"] == len(r["e"])
        assert r["d"] == texts[r["i"]]


@pytest.fixture(scope="module")
def rank_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("ranks") / "tiny.ranks"
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abab", b" a"]
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    return str(path)


def test_rank_file_tokenizer(spark, rank_file):
    bpe = RankFileTokenizer(spark, rank_file)
    assert bpe.eot_id == 259
    texts = ["abab ab", "", "é<|endoftext|>", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    encoded = df.withColumn("e", bpe.encode(F.col("t")))
    rows = {r["i"]: r for r in encoded.withColumn("d", bpe.decode(F.col("e"))).collect()}
    assert rows[0]["e"] == [257, 32, 256]
    assert rows[1]["e"] == [] and rows[3]["e"] is None
    assert 259 not in rows[2]["e"] and rows[2]["d"] == texts[2]
    placed = pack.place_documents(docs(spark, ["abab", "ab ab"]), bpe)
    rows = pack.shard_fragments(placed, bpe, 3).collect()
    stream = [t for r in sorted(rows, key=lambda r: (r["shard_id"], r["shard_pos"])) for t in r["tokens"]]
    assert stream == [259, 257, 259, 256, 32, 256]


def test_ids_out_of_range_are_an_error(spark):
    df = spark.createDataFrame([([1, 70000],)], "t array<int>")
    with pytest.raises(Exception, match="out of range"):
        df.select(checked_ids(F.col("t"))).collect()
    df = spark.createDataFrame([("a",)], "t string")
    assert df.select(with_leading_delimiter(BYTES, F.col("t"))).first()[0] == [256, 97]


def test_shard_files(spark, tmp_path):
    placed = pack.place_documents(docs(spark, TEXTS), BYTES)
    path = str(tmp_path / "shards")
    shards.write_token_shards(pack.shard_fragments(placed, BYTES, 40), path)
    train = shards.read_token_shards(spark, path, "train")
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    assert train.agg(F.sum(F.size("tokens"))).first()[0] == len(stream_of(TEXTS)) - 40
    with pytest.raises(ValueError):
        shards.read_token_shards(spark, path, "test")
    one = str(tmp_path / "one")
    shards.write_token_shards(pack.shard_fragments(placed, BYTES, 10_000), one)
    with pytest.raises(FileNotFoundError):
        shards.read_token_shards(spark, one, "train")
    assert shards.shard_name("corpus", "val", 3) == "corpus_val_000003"


def test_text_corpus_is_one_document_per_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two\n")
    rows = corpus.read_text_corpus(spark, str(tmp_path / "a.txt")).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(0, "line one\nline two\n")]


def test_file_ordinal_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    rows = corpus.with_file_ordinal(spark, path, "id bigint").collect()
    assert all(r["ord"] == r["id"] for r in rows)


def test_no_exchange_to_a_single_task_carries_rows(spark):
    """Only the table of bucket sums may be gathered."""
    plan = pack.place_documents(docs(spark, TEXTS), BYTES)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("SinglePartition" in line and "doc_id" in line)
    assert plan.count("SinglePartition") == 1
    assert "shufflepartitionidpassthrough" in plan


def test_buckets_follow_the_input_so_that_a_task_stays_small(spark):
    # 320 MB by Spark's estimate: a task takes 16 MB of them, whatever the number of cores.
    assert session.default_buckets(spark.range(40_000_000)) == 320_000_000 // (16 * 1024 * 1024)
    assert session.default_buckets(spark.range(400_000_000)) == 3_200_000_000 // (16 * 1024 * 1024)


def test_byte_ids_come_in_batches(spark):
    texts = ["a\u00e9", "", None, "\u65e5x", "\U0001f600" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    ids = df.select("t", BYTES.encode(F.col("t")).alias("ids"))
    assert "ArrowEvalPython" in ids._jdf.queryExecution().executedPlan().toString()
    assert all(r["ids"] == (None if r["t"] is None else list(r["t"].encode())) for r in ids.collect())


def test_digest_writes_the_array_in_one_pass(spark):
    rows = [[1, 2], [], None, [7, None, 3], [None], [256]]
    df = spark.createDataFrame([(r,) for r in rows], "a array<int>")
    found = df.select("a", digest(F.col("a")).alias("d"))
    assert "to_json" in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        joined = None if r["a"] is None else ",".join(str(x) for x in r["a"] if x is not None)
        assert r["d"] == (None if joined is None else hashlib.md5(joined.encode()).hexdigest())


def test_one_split_is_read_without_listing_the_other(spark, tmp_path):
    rows = [("val", 0, 0, 1, [1, 2]), ("train", 1, 0, 2, [3])]
    fragments = spark.createDataFrame(rows, "split string, shard_id long, shard_pos long, doc_id long, tokens array<int>")
    shards.write_token_shards(fragments, str(tmp_path / "s"))
    for split, tokens in (("val", [1, 2]), ("train", [3])):
        found = shards.read_token_shards(spark, str(tmp_path / "s"), split)
        assert [r["tokens"] for r in found.collect()] == [tokens]
        assert all(f"/split={split}/" in name for name in found.inputFiles())
    shards.write_token_shards(fragments.where("split = 'train'"), str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        shards.read_token_shards(spark, str(tmp_path / "t"), "val")


def test_text_files_share_folders_and_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FOLDER_FILES", 10)
    rows = [(7 * i, f"text {i}\nof two lines") for i in range(34)] + [(None, "no id"), (7, None)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    corpus.write_text_corpus(docs, str(tmp_path / "files"))
    folders = [f for f in (tmp_path / "files").iterdir() if f.is_dir()]
    assert len(folders) == 4
    assert sum(len(list(f.glob("part-*"))) for f in folders) == 35
    got = sorted(map(tuple, corpus.read_text_corpus(spark, str(tmp_path / "files")).collect()))
    assert [i for i, _ in got] == list(range(35))
    assert sorted(got[1][1].split("\n")) == ["", "", "of two lines", "text 1"]
    assert [t for i, t in got if i != 1] == [f"{t}\n" for d, t in rows[:35] if d != 7]
