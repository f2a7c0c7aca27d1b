"""Block mixing: targets, draws, permutations and the taken words against a plain version."""

import re
from collections import Counter

import numpy as np

from tokenloom.llm import mixing
from tokenloom.llm.queries import QUERIES


def plain_taken(docs, mix):
    """Words per document, from the slots by counting every single word."""
    streams = {}
    for source in sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or "")):
        mine = sorted(((d, n) for d, n, s in docs if s == source), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        streams[len(streams)] = [d for d, n in mine for _ in range(n)]
    taken = Counter()
    for r in mix.slots().collect():
        at = r["block"] * mix.block_words
        taken.update(streams[r["src"]][at : at + mix.block_words])
    return taken


def test_query_against_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    docs = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    got = QUERIES["op6_block_mix"](spark, sf_dir).collect()
    again = QUERIES["op6_block_mix"](spark, sf_dir).collect()
    assert sorted(got) == sorted(again) and len(got) == len(docs)
    mix = mixing.Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == plain_taken(docs, mix)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    source_of = {d: s for d, _, s in docs}
    for source in set(source_of.values()):
        mine = [r for r in got if source_of[r["doc_id"]] == source]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mixing.BLOCK_WORDS


def test_targets_stop_at_the_cap():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([100]) == [150.0]
    # 150 % of 1110 is 1665; the third source stops at 20, the first at 200, the rest goes on.
    assert mixing.targets([100, 1000, 10]) == [200.0, 1445.0, 20.0]


def test_shards_use_every_quota_once():
    quotas = np.array([1000, 0, 37, 5])
    shards = 11
    seen = [Counter() for _ in quotas]
    for shard in range(shards):
        counts, first = mixing.shard_counts(shard, shards, quotas, 100, 3)
        assert counts.sum() == min(100, max(0, 1042 - 100 * shard))
        for s, (n, f) in enumerate(zip(counts, first)):
            seen[s].update(range(f, f + n))
    assert [sorted(c) for c in seen] == [list(range(q)) for q in quotas]
    assert all(set(c.values()) <= {1} for c in seen)
    huge, _ = mixing.shard_counts(0, 2, np.array([2 * 10**9, 10**9]), 15 * 10**8, 1)
    assert huge.tolist() == [10**9, 5 * 10**8]


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        images = mixing.permuted(np.arange(n), n, (1, 2, 3))
        assert sorted(images.tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), 1000, (1,)) != np.arange(1000)).mean() > 0.9


def test_odd_rows(spark):
    texts = [None, "", "one two three", "a b c", "a b c", "w " * 5000, "x\ny\tz"]
    rows = [(i // 2, t, ("s", None, "S")[i % 3], 5, 1) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "s", None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, source string, n_chars int, size int"
    docs = spark.createDataFrame(rows, schema)
    got = mixing.Mix(docs, block_words=2, shard_slots=7).taken().collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    mixed = mixing.mixed_documents(docs, block_words=2, shard_slots=7)
    assert mixed.columns == docs.columns
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)
    empty = docs.limit(0)
    assert mixing.Mix(empty).taken().count() == mixing.mixed_documents(empty).count() == 0


def test_slots_are_not_broadcast(spark):
    rows = [(i, "w " * 50, "s") for i in range(20)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for df in (mix.taken(), mix.stream()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[src#\d+, block#\d+L\]", plan)
        assert not re.search(r"BroadcastHashJoin \[src#\d+, block#\d+L\]", plan)
