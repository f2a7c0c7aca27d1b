"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from tokenloom.llm import bpe
from tokenloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(PATH),
        special_tokens={},
    )


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_query_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        coded = digest(" ".join(map(str, ids)).encode())
        want.add((doc_id, len(ids), coded, digest((text or "").encode())))
    got = QUERIES["op5_folded_bpe"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("numbered, long_word", [(300_000, 48), (5, 3)])
def test_odd_rows(spark, library, monkeypatch, numbered, long_word):
    monkeypatch.setattr(bpe, "NUMBERED_WORDS", numbered)
    monkeypatch.setattr(bpe, "LONG_WORD", long_word)
    monkeypatch.setattr(bpe, "BLOCK_DOCS", 2)
    texts = [
        None, "", " ", "\n\n  x", "it's we'll I'D", "a  b   c ", "tab\t\tend\r\n", "\x1c\x85  　z",
        "naïve é ß 漢字 \U0001f600\U0001f468‍\U0001f469", "12345 ٣٤ ½", "!!??...", "z" * 3000,
        "word " * 20_000, "<|endoftext|>", "same", "same",
    ]
    rows = [(i // 2, t, "x", [1]) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    coded = bpe.encode(docs.repartition(2), PATH, public_tokenizers.PATTERN)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in coded.collect()), key=str)
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in rows]
    assert got == sorted(want, key=str)
    again = bpe.decode(coded.drop("decoded"), PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in again) == sorted(t for _, _, t in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_literal_map_holds_every_pair():
    pairs = bpe.pair_ranks(bpe.read_ranks(PATH))
    shift, entries = bpe.literal_map(pairs)
    for key, rank in pairs.items():
        assert entries[shift[key >> 16] + (key & 0xFFFF)] == key >> 16 << 16 | rank
    assert sum(e != bpe._NO_ENTRY for e in entries) == len(pairs)


def test_units_between_single_spaces_keep_the_words():
    split = regex.compile(public_tokenizers.PATTERN).findall
    units_of = regex.compile(r"(?<=\S) (?=\S)").split
    rng = random.Random(5)
    texts = ["", " ", "a", " a", "a ", "a b", "it 's 've'll I'D", "a  b c\n d\x1c e \x85 f\u3000 g"]
    texts += ["".join(rng.choices(" \n\t\x1c\x85\xa0\u3000ab'sé漢1½!", k=rng.randrange(60))) for _ in range(5000)]
    cut = 0
    for text in texts:
        first, middle, last = bpe._units(text, units_of)
        cut += len(middle)
        words = [*split(first), *(w for u in middle for w in split(" " + u)), *split(last)]
        assert words == split(text)
        assert all(u[:1].strip() and u[-1:].strip() for u in middle if "\x1c" not in u)
    assert cut > 1000 and bpe.SPACED_PATTERN == public_tokenizers.PATTERN
    assert bpe._units("a b c", None) == ("a b c", [], "")


def test_words_are_kept_in_arrays():
    rng = random.Random(3)
    held, want = bpe._Joined("int32"), []
    for _ in range(300):
        new = [[rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 900]))] for _ in range(rng.randrange(40))]
        held.add(np.array(sum(new, []), np.int32), np.array([len(x) for x in new], np.int32))
        want += new
    numbers = [rng.randrange(len(want)) for _ in range(50)]
    values, ends = held.take(pa.array(numbers, pa.int32()), np.array([0, 20, 20, 50]))
    parts = [sum((want[i] for i in part), []) for part in (numbers[:20], [], numbers[20:])]
    assert pa.ListArray.from_arrays(ends, values).to_pylist() == parts
    # At most twice what is held.
    assert held.values.nbytes <= 8 * sum(map(len, want)) and held.ends.nbytes <= 8 * len(want) + 16_384


def test_blocks_without_words(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_DOCS", 2)
    rows = [(1, None), (2, ""), (3, None), (4, None), (5, "ab ab"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert [(r["doc_id"], bytes(r["decoded"])) for r in got] == [(i, (t or "").encode()) for i, t in rows]
    assert all(bool(r["ids"]) == bool(t) for r, (_, t) in zip(got, rows))
