"""Collocations against brute force, with shards and passes of every size, and odd rows."""

import random
import re
from collections import Counter

from tokenloom.llm import phrases

SCHEMA = "doc_id long, lang string, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, top):
    counts, totals = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= support}
    out = []
    for lang in totals:
        kept = []
        for (own, words), a in found.items():
            if own != lang:
                continue
            longer = [
                a2
                for (l2, w2), a2 in found.items()
                if l2 == lang and len(w2) > len(words)
                and any(w2[i : i + len(words)] == words for i in range(len(w2)))
            ]
            if any(a2 >= a for a2 in longer):
                continue
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            kept.append((-score, -a, " ".join(words).encode(), l, r))
        for rank, (score, a, words, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, words.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def run(df, support=5, top=40, **more):
    got = phrases.collocations(df, support, top, **more).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


def texts(n, seed=0):
    rng = random.Random(seed)
    words = "the of And a b c dé X-ray 12".split()
    out = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " "])
            if rng.random() < 0.1:
                text += "over the hills and far away "
        out.append((i, rng.choice(["en", "en", "de", None]), text))
    return out


def test_equals_brute_force(spark):
    rows = texts(200)
    want = brute(rows, 5, 40)
    assert len(want) > 60 and run(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want


def test_many_shards_and_passes(spark, monkeypatch):
    rows = texts(120, seed=2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(phrases, "LEAST_SHARD_BYTES", 500)
    monkeypatch.setattr(phrases, "SPREAD_SHARDS", 4)
    monkeypatch.setattr(phrases, "BATCH_PHRASES", 60)
    monkeypatch.setattr(phrases, "STEP_BYTES", 300)
    monkeypatch.setattr(phrases, "EMIT_ROWS", 7)
    # Full shards: more of them than the support, so that every phrase is a candidate.
    for shard_bytes in (1 << 20, 1200):
        assert run(df, shard_bytes=shard_bytes) == brute(rows, 5, 40)


def test_local_support_excludes_rare_phrases():
    shard = phrases.Shard()
    shard.add([b"a b c. a b d. a b c"])
    found = {p: int(c) for _, ps, cs in shard.mine(2) for p, c in zip(ps, cs)}
    assert found == {b"a": 3, b"b": 3, b"c": 2, b"d": 1, b"a b": 3, b"b c": 2, b"a b c": 2}


def test_odd_rows(spark):
    copies = [(None, None, "one two three")] * 30 + [(7, "en", "one two three")] * 30
    odd = [(1, "en", None), (2, "en", ""), (3, None, " \t\n"), (4, "und", "one two three four")]
    long = [(5, "fr", "la vie en rose " * 20_000)]
    rows = copies + odd + long
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, 40)
    assert {r[0] for r in want} == {"en", "und", "fr"} and run(df) == want
    clashing = df.selectExpr("*", "1 AS phrase", "2 AS a", "3 AS words", "4 AS shard", "5 AS size")
    assert run(clashing) == want
    assert run(df, shard_bytes=50_000) == want


def test_ties_and_products_beyond_64_bits(spark):
    rows = [(1, "en", "b a. d c. a b. c d. " * 10)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 5, 40)
    big = spark.createDataFrame([(10**13, 10**14, 10**13, 3 * 10**13)], "a long, n long, l long, r long")
    got = big.select(phrases._score(*[big[c] for c in "anlr"]).alias("s")).first()["s"]
    assert got == 1000 * 10**13 * 10**14 // (10**13 * 3 * 10**13)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(1, "en", None), (2, "en", "a b")], SCHEMA)) == []
