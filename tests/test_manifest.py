"""Manifest of stored shards, positions by its directory, windows by their edges, pruning."""

import random

from pyspark.sql import functions as F

from tokenloom.operators import losses, pack, windows
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.sources import shards

BYTES = ByteTokenizer()


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.choice([0, 1, 3, 15, 16, 17, 40, 200])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def stream(rows):
    out = []
    for doc, text in rows:
        out += [(doc, 256)] + [(doc, b) for b in text.encode()]
    return out


def test_manifest_and_positions(spark, tmp_path):
    docs, rows = corpus(spark)
    path = str(tmp_path / "shards")
    placed = pack.place_documents(docs, BYTES)
    shards.write_token_shards(pack.shard_fragments(placed, BYTES, 500), path)
    manifest = shards.write_manifest(spark, path, mark_tokens=64)
    whole = stream(rows)
    got = {r["shard_id"]: r for r in manifest.collect()}
    assert {s: r["n_tokens"] for s, r in got.items()} == {
        s: len(whole[s * 500 : s * 500 + 500]) for s in range(-(-len(whole) // 500))
    }
    assert shards.shard_faults(manifest, 500).count() == 0
    asked = [(p // 500, p % 500) for p in range(0, len(whole), 7)] + [(0, 500), (0, -1), (99, 0)]
    positions = spark.createDataFrame(asked, "shard_id long, shard_pos long")
    stored = shards.read_token_shards(spark, path)
    found = shards.fragments_at(positions, manifest, stored, mark_tokens=64).collect()
    firsts = {}
    for at, (doc, _) in enumerate(whole):
        firsts.setdefault((doc, at // 500), at)
    assert sorted((r["shard_id"], r["shard_pos"], r["doc_id"], r["doc_offset"]) for r in found) == sorted(
        (s, p, whole[s * 500 + p][0], s * 500 + p - firsts[whole[s * 500 + p][0], s]) for s, p in asked[:-3]
    )
    # Readers of the shards do not see the manifest.
    assert stored.agg(F.sum("n_piece")).first()[0] == len(whole)


def test_faults(spark):
    schema = "split string, shard_id long, n_tokens long, end long"
    rows = [("val", 0, 10, 10), ("train", 2, 10, 10), ("train", 2, 10, 10), ("train", 3, 8, 10),
            ("train", 4, 8, 8), ("train", 5, 3, 3)]
    found = shards.shard_faults(spark.createDataFrame(rows, schema), 10).collect()
    assert {(r["shard_id"], r["fault"]) for r in found} == {
        (1, "missing"), (2, "doubled"), (3, "torn"), (4, "short"),
    }
    assert shards.shard_faults(spark.createDataFrame([], schema), 10).count() == 0


def test_windows_of_every_width(spark):
    docs, rows = corpus(spark, seed=5)
    whole = [t for _, t in stream(rows)]
    fragments = pack.shard_fragments(pack.place_documents(docs, BYTES), BYTES, 700)
    fragments.cache()
    for width in (1, 2, 16, 17, 64):
        got = {(r["shard_id"], r["win"]): list(r["tokens"]) for r in windows.window_tokens(fragments, width).collect()}
        want = {}
        for shard in range(-(-len(whole) // 700)):
            part = whole[shard * 700 : shard * 700 + 700]
            for win in range((len(part) - 1) // width):
                want[shard, win] = part[win * width : win * width + width + 1]
        assert got == want


def test_only_edges_are_shuffled(spark, tmp_path):
    """One long document: nothing but the parts at its two ends meets others."""
    docs = spark.createDataFrame([(0, "a" * 10), (1, "b" * 50_000), (2, "c")], "doc_id long, text string")
    path = str(tmp_path / "f")
    pack.shard_fragments(pack.place_documents(docs, BYTES), BYTES).write.parquet(path)
    rows = windows.window_tokens(spark.read.parquet(path), 64)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == (50_000 + 11 + 1 + 2 - 1) // 64 and "Union" in plan
    # Four fragments' ends at most reach the aggregate.
    aggregate = [line for line in plan.splitlines() if "collect_list" in line]
    assert len(aggregate) == 1


def test_pruned_documents(spark):
    docs, rows = corpus(spark)
    placed = pack.place_documents(docs, BYTES)
    whole = stream(rows)
    for begin, end in ((0, 1), (0, 100), (50, 51), (100, 300)):
        got = {r["doc_id"] for r in pack.within(placed, end, begin).collect()}
        assert got == {doc for doc, _ in whole[begin:end]}


def test_running_batches_wrap(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0), (2, 6.0)], "batch_id long, loss double")
    for running in (1, 2, 3, 4, 7):
        means = [2.0, 4.0, 6.0]
        want = sum(means[g % 3] for g in range(running)) / running
        got = losses.mean_of_running_batches(rows, running).first()
        assert abs(got["loss"] - want) < 1e-12 and got["n_batches"] == min(running, 3)
    assert losses.mean_of_running_batches(rows.limit(0), 3).first()["loss"] is None


def test_computed_order_serves_every_row_once_an_epoch(spark):
    lengths = spark.createDataFrame([("train", 1, 100), ("train", 3, 41), ("val", 0, 20), ("train", 4, 0)],
                                    "split string, shard_id long, n_tokens long")
    placed = {r["shard_id"]: (r["first_row"], r["split_rows"]) for r in windows.with_ordinal(lengths, 10).collect()}
    assert placed == {1: (0, 13), 3: (9, 13), 4: (13, 13), 0: (0, 1)}
    rows = spark.range(13).select(F.col("id").alias("row"), F.lit(13).cast("long").alias("n_rows"))
    ordered = windows.computed_order(rows, seed=5, epochs=F.array(F.lit(0), F.lit(1), F.lit(2)))
    assert "Exchange" not in ordered._jdf.queryExecution().executedPlan().toString()
    got = ordered.collect()
    orders = [tuple(r["row"] for r in sorted(got, key=lambda r: r["perm_pos"]) if r["epoch"] == e) for e in range(3)]
    assert all(sorted(o) == list(range(13)) for o in orders) and len(set(orders)) == 3
