"""SimHash fingerprints, the positional index and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tokenloom.llm import simhash
from tokenloom.llm.components import connected
from tokenloom.llm.queries import QUERIES


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    if len(words) < 3:
        shingles = [" ".join(words)]
    else:
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by union of all pairs."""
    parent = {i: i for i in range(len(prints))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (doc, _) in enumerate(prints):
        ids.setdefault(root(i), []).append(doc)
    smallest = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [smallest[root(i)] for i in range(len(prints))]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs]
    want = {
        (d, f"{fp:016x}", c) for (d, fp), c in zip(prints, plain_components(prints))
    }
    got = QUERIES["op4_simhash_components"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == want
    assert len(got) == len(docs)


def test_odd_rows(spark):
    texts = [None, "", "  ", "One", "one", "one two", "a b c", "A B C", "x " * 200_000, "a b c"]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "a b c", None, None), (0, None, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    signed = [int(np.array([fp], dtype=np.uint64).view(np.int64)[0]) for _, fp in prints]
    want = [(d, s, c) for (d, _), s, c in zip(prints, signed, plain_components(prints))]
    assert got == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want})
    assert ids.count(None) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("matrix", [4, 512])
def test_similar_links_whole_balls(spark, monkeypatch, matrix):
    """Chains and dense balls: both ways through a list connect what all pairs would."""
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(20)}
    base = rng.getrandbits(48) << 16
    prints |= {base | v for v in rng.sample(range(1 << 16), 600)}
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.similar_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"))
    label = {r["node"]: r["component"] for r in connected(edges).collect()}
    want = plain_components(list(enumerate(prints)))
    got = [label.get(s, s) for s in signed]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_path(spark):
    n = 300
    path = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)]
    found = connected(spark.createDataFrame(path, "src long, dst long")).collect()
    assert {r["component"] for r in found if r["node"] <= n} == {0}
    assert {r["component"] for r in found if r["node"] >= 1000} == {1000}
    assert len(found) == n + 3
