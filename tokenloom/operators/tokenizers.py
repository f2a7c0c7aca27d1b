"""Tokenizers behind one interface: columns in, columns out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import let, utf8_ids


class Tokenizer(Protocol):
    eot_id: int
    vocab_size: int
    native: bool  # True when counting is a plain Spark expression and encoding costs little

    def encode(self, text: Column) -> Column: ...

    def count(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


class ByteTokenizer:
    """UTF-8 bytes as ids 0-255 and the delimiter as 256; counts need no encoding."""

    eot_id = 256
    vocab_size = 257
    native = True

    def encode(self, text: Column) -> Column:
        return utf8_ids(text)

    def count(self, text: Column) -> Column:
        return F.octet_length(text)

    def decode(self, ids: Column) -> Column:
        latin = F.array_join(
            F.transform(
                ids,
                lambda t: F.when(t == self.eot_id, F.lit(fv.END_OF_TEXT)).otherwise(
                    F.char(t.cast("bigint"))
                ),
            ),
            "",
        )
        return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


# Fixed value: the split pattern published with the widely used 50k-entry byte-pair vocabulary.
BPE_SPLIT_PATTERN = (
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


class RankFileTokenizer:
    """Byte-pair encoding from a rank file (``base64-token rank`` per line).

    The rank file is read once and broadcast: its size is that of the vocabulary,
    not of the data, and is checked against the 16-bit id limit. Each Python
    worker builds the encoder once and then serves whole Arrow batches.
    """

    native = False

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str = BPE_SPLIT_PATTERN):
        lines = spark.read.text(rank_file).limit(fv.TOKEN_ID_LIMIT + 1).collect()
        ranks = [line.value.split() for line in lines if line.value.strip()]
        self.eot_id = max(int(rank) for _, rank in ranks) + 1
        self.vocab_size = self.eot_id + 1
        if self.vocab_size > fv.TOKEN_ID_LIMIT:
            raise ValueError("token ids have to fit into 16 bits")
        self._ranks = spark.sparkContext.broadcast({token: int(rank) for token, rank in ranks})
        self._pattern = pattern

    def _encoding(self):
        ranks, pattern, eot = self._ranks, self._pattern, self.eot_id

        def build():
            import base64

            import tiktoken

            return tiktoken.Encoding(
                name="rank_file",
                pat_str=pattern,
                mergeable_ranks={base64.b64decode(t): r for t, r in ranks.value.items()},
                special_tokens={fv.END_OF_TEXT: eot},
            )

        return build

    def encode(self, text: Column) -> Column:
        build = self._encoding()

        @F.pandas_udf("array<int>")
        def encode_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoding = build()
            for texts in batches:
                yield pd.Series(
                    [None if t is None else encoding.encode_ordinary(t) for t in texts]
                )

        return encode_batch(text)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))

    def decode(self, ids: Column) -> Column:
        build = self._encoding()

        @F.pandas_udf("string")
        def decode_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoding = build()
            for rows in batches:
                yield pd.Series(
                    [None if r is None else encoding.decode([int(t) for t in r]) for r in rows]
                )

        return decode_batch(ids)


def with_leading_delimiter(tokenizer: Tokenizer, text: Column) -> Column:
    """Corpus form of a document: the delimiter comes first."""
    return F.concat(F.array(F.lit(tokenizer.eot_id)), tokenizer.encode(text))


def checked_ids(ids: Column, limit: int = fv.TOKEN_ID_LIMIT) -> Column:
    """The ids themselves, or an error when one of them does not fit the storage type."""
    return let(
        ids,
        lambda a: F.when(
            (F.array_max(a) >= limit) | (F.array_min(a) < 0),
            F.raise_error(F.lit("token id out of range")).cast("array<int>"),
        ).otherwise(a),
    )
