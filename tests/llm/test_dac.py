"""Directly addressable codes: format, random access, order, and ids against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from tokenloom.llm import dac
from tokenloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 1] for e in found]


def expected(rows):
    out, start = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc_id, _), ids in zip(rows, library_ids([t for _, t in rows])):
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        out.append((doc_id, start, len(ids), crc))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op3_addressable_tokens"](spark, sf_dir).collect()))
    assert got == expected([tuple(r) for r in docs])


def test_odd_rows(spark, tmp_path):
    texts = [
        None, "", " \n\t ", "Plain\x1cwords here  and　there", "é ̸x",
        "a <|endoftext|> b", "<|startoftext|>x", "A<|endoftext|>.", "<|ENDOFTEXT|> is text",
        "É <|endoftext|>", "<|endoftext|><|endoftext|>, END", "it's 12'34 ...!? \U0001f600", "İstanbul ΣΣ ß",
        "a\r\nb\x0bc\x0cd", "word " * 50_000, "x" * 20_000, "same", "same",
    ]
    rows = [(i // 2, t, "n", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segment string, bucket int")
    path = str(tmp_path / "segments")
    dac.write_segments(docs, path, PATH, segment_tokens=1000, bucket_rows=3)
    found = dac.read_documents(spark, path).orderBy("start").collect()
    want = expected([r[:2] for r in rows])
    assert [tuple(r)[:4] for r in found] == want
    assert spark.read.parquet(path).count() > 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dac.round_trip(docs, PATH).count() == 0


@pytest.mark.parametrize("top", [2, 255, 256, 1 << 16, 1 << 32])
def test_every_token_is_addressable(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
    ids[::7] %= 300
    counts = np.array([1000, 0, 2000])
    segment = dac.DacSegment(dac.encode_segment([5, None, 7], counts, ids, 11))
    assert segment.doc_ids == [5, None, 7] and segment.start == 11
    for a, b in [(0, 3000), (0, 0), (3000, 3000), (0, 1), (2999, 3000), *rng.integers(0, 3001, (40, 2))]:
        assert segment.tokens(a, b).tolist() == ids[a:b].tolist()
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist()


def test_the_earlier_table_is_asked_and_not_gone_through():
    class Table(dict):
        def __iter__(self):
            raise AssertionError("every block of texts would pay for the whole table")

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two, three", "two four"]
    want = dac.WordTokenizer(path)(texts)
    tokenizer = dac.WordTokenizer(path)
    tokenizer(texts[:1])
    tokenizer._known, tokenizer._earlier = {}, Table(tokenizer._known)
    assert tokenizer(texts) == want
    assert set(tokenizer._known) >= {"one", "two,", "three", "four"}
