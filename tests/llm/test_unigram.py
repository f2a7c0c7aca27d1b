"""Unigram language identification: the forward pass against all segmentations, and accuracy."""

import zlib
from math import log

import numpy as np
import public_tokenizers
import pytest

from tokenloom.llm import unigram
from tokenloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces(PATH)


def segmentations(pieces, word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces.number:
            for rest in segmentations(pieces, word[n:]):
                yield [pieces.number[word[:n]], *rest]


def test_sum_over_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    prob = rng.dirichlet(np.ones(len(pieces)), 2)
    words = [b" the", b" strasse", " été".encode(), b" a", " ß".encode()]
    got = unigram.log_probabilities(pieces, words, prob)
    uses = unigram.expected_counts(pieces, words, np.array([1, 2, 3, 4, 5]), prob[0])
    want_uses = np.zeros(len(pieces))
    for i, word in enumerate(words):
        paths = list(segmentations(pieces, word))
        for lang in range(2):
            want = sum(np.prod(prob[lang][p]) for p in paths)
            assert got[i, lang] == pytest.approx(log(want))
        weights = np.array([np.prod(prob[0][p]) for p in paths])
        for path, share in zip(paths, weights / weights.sum()):
            np.add.at(want_uses, path, (i + 1) * share)
    assert uses == pytest.approx(want_uses)


def test_long_words_agree(pieces, monkeypatch):
    prob = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 3)
    words = [b" abcdefghijklmnopqrstuvwxyz" * 2, b" thethethe", b" q"]
    whole = unigram.log_probabilities(pieces, words, prob)
    monkeypatch.setattr(unigram, "LONG_WORD", 1)
    assert unigram.log_probabilities(pieces, words, prob) == pytest.approx(whole)
    assert np.isfinite(unigram.log_probabilities(pieces, [b" " + b"z" * 30_000], prob)).all()


def test_every_piece_of_the_vocabulary_counts(pieces):
    import base64

    with open(PATH, "rb") as lines:
        assert {base64.b64decode(line.split()[0]) for line in lines} <= set(pieces.number)
    word = max((p for p in pieces.number if p.startswith(b" ") and p[1:].isalpha() and p[1:].islower()), key=len)
    assert len(word) > 12
    found = pieces.edges([word])
    assert pieces.number[word] in found[3].tolist()
    everywhere = {
        (a, b) for a in range(len(word)) for b in range(a + 1, len(word) + 1) if word[a:b] in pieces.number
    }
    assert set(zip(found[1].tolist(), found[2].tolist())) == everywhere


def test_rare_letters_after_large_counts(pieces):
    """Probabilities of a hundred million counted pieces: no sum underflows, short or long."""
    prob = np.full((2, len(pieces)), unigram.SMOOTHING)
    prob[:, pieces.number[b" the"]] += [1e9, 2e9]
    prob /= prob.sum(axis=1, keepdims=True)
    words = [b" " + bytes([0xF3, 0xB1]) * 31, b" the", b" " + b"qz" * 300]
    scores = unigram.log_probabilities(pieces, words, prob)
    assert np.isfinite(scores).all()
    assert scores[0, 0] - scores[0, 1] == pytest.approx(63 * log(2), rel=0.02)
    uses = unigram.expected_counts(pieces, words, np.array([1, 1, 1]), prob[0])
    assert np.isfinite(uses).all() and uses[pieces.number[b" the"]] == pytest.approx(1)
    assert (uses * pieces.length).sum() == pytest.approx(sum(map(len, words)))


def test_long_uses_agree(pieces, monkeypatch):
    prob = np.random.default_rng(2).dirichlet(np.ones(len(pieces)))
    words = [b" abcdefghijklmnopqrstuvwxyz", b" thethethe", b" q"]
    whole = unigram.expected_counts(pieces, words, np.array([3, 2, 1]), prob)
    monkeypatch.setattr(unigram, "LONG_WORD", 1)
    assert unigram.expected_counts(pieces, words, np.array([3, 2, 1]), prob) == pytest.approx(whole)


def test_query_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs}
    got = QUERIES["op1_unigram_langid"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(lang) and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in unseen)
    assert right >= 0.95 * len(unseen)


def test_odd_rows(spark):
    rows = [(i, t, None, "s", 1.0) for i, t in enumerate([None, "", "12 !! ²", "le jardin", "x" * 30_000])]
    rows += [(None, "the house and the garden", "en", None, None)] * 2
    rows += [(40 + i, "la maison et le jardin", "fr", None, None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = unigram.identify(docs, PATH).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert by_id[0]["score"] == 0 and by_id[3]["lang_pred"] == "fr"
    assert by_id[None]["lang_pred"] == "en"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in unigram.identify(docs, PATH).collect()] == ["und"]
    assert unigram.identify(docs.limit(0), PATH).count() == 0
