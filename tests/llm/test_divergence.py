"""Quality rules: the SQL check, the divergence itself, and odd rows."""

import math

import numpy as np
import pytest

from check import compare
from tokenloom.llm import divergence
from tokenloom.llm.queries import CHECKS, QUERIES


def test_query_matches_sql(spark, duck, sf_dir):
    name = "op2_divergence_quality"
    verdict, _, _ = compare(spark, duck, sf_dir, name, QUERIES[name], CHECKS[name])
    assert verdict.startswith("ok"), verdict


def test_js_distance(spark):
    rows = [([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.3, 0.7], [0.3, 0.7])]
    same = [divergence.js_distances(np.array([p]), np.array([q]))[0] for p, q in rows]
    assert same == pytest.approx([math.sqrt(0.5), 1.0, 0.0])
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    got = [r[0] for r in df.select(divergence.js_distance(df.p, df.q)).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 1.0, 0.0])


def test_repeated_words_counts_covered_positions():
    def plain(words):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        return len(
            {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        )

    for text in ("", "a", "a a a a", "a b c a b c", "x a b c y a b c z", "a b a b a b c d e f d e f"):
        assert divergence.repeated_words(text.split()) == plain(text.split())


def test_odd_rows(spark):
    clean = " ".join(f"the house{i} and of a garden{i} in the town{i} is small{i}." for i in range(60))
    junk = " ".join(f"Wo%%%{i} ti&&&{i} he***{i} an$$${i}" for i in range(60))
    texts = [None, "", "\n\n", "word " * 100, clean, clean, junk, "dup\nline\ndup\n \n \n", "x" * 200_000]
    rows = [(i, t, None if t == junk else "en", "s", 1, True) for i, t in enumerate(texts)] + [(None, clean, None, None, 0, False)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean"
    )
    found = {r["doc_id"]: r for r in divergence.quality(docs).collect()}
    assert [found[i]["n_words"] for i in (0, 1, 2, 3)] == [0, 0, 0, 100]
    assert [found[i]["kept"] for i in (0, 1, 3, 4, 5, 6, None)] == [False, False, False, True, True, False, True]
    assert found[7]["n_dup_lines"] == 1 and found[3]["base_failed"]
    kept = divergence.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["n_words"]) for r in kept.collect() if r["doc_id"] is not None) == [(4, 1), (5, 1)]
    assert kept.where("doc_id is null").count() == 1
    assert divergence.quality(docs.limit(0)).count() == divergence.keep_good(docs.limit(0)).count() == 0


def test_short_texts_have_a_wider_limit(spark):
    """From 100 words on; below that the word histogram decides nothing."""
    plain = lambda n: " ".join(f"the house{i} and of a garden{i} in the town{i} is small{i}." for i in range(n))
    strange = lambda n: " ".join(f"grund{i}" for i in range(n))
    texts = [plain(200), plain(10), strange(99), strange(100), strange(150), strange(220)]
    docs = spark.createDataFrame(
        [(i, t, "en" if i == 0 else None, "s") for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string",
    )
    found = {r["doc_id"]: r["kept"] for r in divergence.quality(docs).collect()}
    assert [found[i] for i in range(6)] == [True, True, True, False, False, False]
    assert sorted(r["doc_id"] for r in divergence.keep_good(docs).collect()) == [0, 1, 2]
    # At one distance a text of 110 words passes and one of 190 does not.
    references = [("en", [1], [60, 40])]
    words = np.array([110, 190, 400])
    counts = np.stack([3 * words // 10, words - 3 * words // 10], axis=1)
    commons, reference = np.array([[33.0, 77.0]]), np.array([[60.0, 40.0]])
    assert 0.24 < divergence.js_distances(commons, reference)[0] < 0.27
    found = divergence.verdicts(words, 0 * words, words[:, None], counts, references)
    assert found[-1].tolist() == [True, False, False]
