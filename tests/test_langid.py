"""Language scores against a plain reading of the texts, in both branches."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tokenloom.operators import langid

TEXTS = {
    "en": "the cat and the dog are in the house",
    "el": "η γάτα και ο σκύλος είναι στο σπίτι",
    "zh": "猫和狗在房子里𠀀𠀁𠀂𠀀",
}


def plain(train, text):
    counts = {lang: Counter(_grams(t)) for lang, t in train}
    if not _grams(text):
        return None
    scores = []
    for lang, seen in counts.items():
        mass = seen.total() + langid.SMOOTHING * langid.VOCABULARY
        scores.append((sum(math.log((seen[g] + langid.SMOOTHING) / mass) for g in _grams(text)), lang))
    return max(scores)[1]


def _grams(text):
    text = (text or "").lower()
    return [text[i : i + 3] for i in range(len(text) - 2)]


def asked_rows():
    rng = random.Random(3)
    rows = [(0, ""), (1, None), (2, "ab"), (3, "𠀀𠀁𠀂"), (4, "ΣΚΎΛΟΣ και the"), (5, "\x7f\x80ÿ" * 3)]
    for k in range(6, 60):
        words = " ".join(TEXTS[rng.choice(list(TEXTS))] for _ in range(rng.randint(1, 3))).split()
        rng.shuffle(words)
        rows.append((k, " ".join(words)[: rng.randint(0, 40)]))
    return rows


@pytest.mark.parametrize("weights, chars", [(8_000_000, 1 << 20), (8_000_000, 50), (3, 50)])
def test_scores(spark, monkeypatch, weights, chars):
    """Table in one slice, in many, and the join of counted trigrams."""
    monkeypatch.setattr(langid, "BROADCAST_WEIGHTS", weights)
    monkeypatch.setattr(langid, "SLICE_CHARS", chars)
    train = spark.createDataFrame(list(TEXTS.items()), "lang string, text string")
    profile = langid.train_profile(train)
    rows = asked_rows()
    asked = spark.createDataFrame(rows, "k long, text string").repartition(3)
    got = langid.identify(asked, profile, keys=["k"])
    assert {r["k"]: r["language"] for r in got.collect()} == {
        k: plain(TEXTS.items(), text) for k, text in rows
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning" in plan) == (weights == 3) and "Generate explode(regexp" not in plan


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", 30)
    rows = [("en", "aaaa"), ("en", "AAA b"), (None, "aaa"), ("fr", None), ("fr", "ab"), ("zh", "𠀀a𠀀a")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = Counter((lang, g) for lang, t in rows for g in _grams(t))
    got = langid.trigram_counts(df).collect()
    assert {(r["lang"], r["tri"]): r["n"] for r in got} == want


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    profile = langid.train_profile(empty)
    asked = spark.createDataFrame([(1, "abc")], "k long, text string")
    assert [r["language"] for r in langid.identify(asked, profile, keys=["k"]).collect()] == [None]


def test_weights_are_summed_along_the_rows():
    rng = np.random.default_rng(0)
    known = ["the", "he ", "η γ", "abc", "b\u00e9c"]
    weights = rng.normal(size=(len(known), 3))
    table = langid.WeightTable(known, weights, [-9.0, -8.0, -7.0])
    assert table.weights.shape == (3, len(known) + 1) and table.weights.flags["C_CONTIGUOUS"]
    texts = ["the he ", "", "η γabc", "b\u00e9c", "xyz"]
    got = table.sums(*langid.trigram_codes(texts))
    want = [
        sum(weights[known.index(g)] if g in known else np.array([-9.0, -8.0, -7.0]) for g in _grams(t))
        for t in texts if _grams(t)
    ]
    assert np.allclose(got, want)
