"""Pseudorandom permutations of 0..n-1 that are computed element by element.

A number is written with two digits, ``left * width + right``, over the smallest rectangle
that holds all ``n``. Every round adds a hash of one digit to the other one, modulo its
base, which can be undone by subtracting. An image outside of the range is permuted again until it
falls inside; less than one in ``width`` numbers lie outside, so that this is rare.
The hash is the head of an md5 over text, which any engine can repeat.

A digit has about the root of ``n`` values, so that whole columns are permuted with the hashes
of every digit kept in small tables, instead of hashing for each number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.arrays import let

ROUNDS = 6
#: Steps of one walk: more than the numbers outside where n is small, and never needed where
#: it is large.
STEPS = 48


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _whole(value: int | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def bases(n: Column) -> tuple[Column, Column]:
    """Bases of the two digits: ``width`` is the root of ``n``, rounded up."""
    width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    return F.greatest(_div(n + width - 1, width), F.lit(1).cast("bigint")), width


def _hash(seed: Column, epoch: Column, number: int, digit: Column) -> Column:
    text = F.concat_ws("-", *[c.cast("string") for c in (seed, epoch, F.lit(number), digit)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _rounds(x: Column, n: Column, seed: Column, epoch: Column, numbers: list[int], sign: int) -> Column:
    height, width = bases(n)

    def step(number: int):
        def run(pair: Column) -> Column:
            left, right = pair["left"], pair["right"]
            if number % 2:
                right = F.pmod(right + sign * F.pmod(_hash(seed, epoch, number, left), width), width)
            else:
                left = F.pmod(left + sign * F.pmod(_hash(seed, epoch, number, right), height), height)
            return F.struct(left.alias("left"), right.alias("right"))

        return run

    pair = F.struct(_div(x, width).alias("left"), F.pmod(x, width).alias("right"))
    for number in numbers:
        pair = let(pair, step(number))
    return let(pair, lambda p: p["left"] * width + p["right"])


def _walk(x: Column, n: Column, once) -> Column:
    """``once`` until the image lies below ``n``; an inside one is left alone."""
    first = once(_whole(x))
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), first, lambda y, _: F.when(y < n, y).otherwise(once(y))
    )
    return F.when(found < n, found).otherwise(
        F.raise_error(F.lit("no image inside the range")).cast("bigint")
    )


def permuted(x: Column, n: Column, seed: int | Column, epoch: int | Column) -> Column:
    """Image of ``x`` under the permutation of ``0..n-1`` that seed and epoch name."""
    numbers = list(range(ROUNDS))
    return _walk(
        x, n, lambda y: _rounds(y, _whole(n), _whole(seed), _whole(epoch), numbers, 1)
    )


def unpermuted(y: Column, n: Column, seed: int | Column, epoch: int | Column) -> Column:
    """The number whose image is ``y``: what is served at a position."""
    numbers = list(reversed(range(ROUNDS)))
    return _walk(
        y, n, lambda x: _rounds(x, _whole(n), _whole(seed), _whole(epoch), numbers, -1)
    )


@lru_cache(maxsize=8)
def _digit_tables(n: int, seed: int, epoch: int) -> tuple[int, int, list[np.ndarray]]:
    """Bases of the two digits, and for each round the hash of every digit it may meet."""
    width = max(int(np.ceil(np.sqrt(np.float64(n)))), 1)
    height = max((n + width - 1) // width, 1)

    def hashed(number: int, digit: int) -> int:
        text = f"{seed}-{epoch}-{number}-{digit}".encode()
        return int.from_bytes(hashlib.md5(text, usedforsecurity=False).digest()[:4], "big")

    tables = [
        np.fromiter((hashed(number, d) for d in range(count)), dtype=np.int64, count=count)
        for number in range(ROUNDS)
        for count in [height if number % 2 else width]
    ]
    return height, width, tables


def permuted_array(x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Images of numbers below ``n``, as ``permuted`` gives them."""
    height, width, tables = _digit_tables(n, seed, epoch)
    y, walking = x.astype(np.int64), np.arange(len(x))
    for _ in range(STEPS + 1):
        left, right = np.divmod(y[walking], width)
        for number, table in enumerate(tables):
            if number % 2:
                right = (right + table[left]) % width
            else:
                left = (left + table[right]) % height
        y[walking] = left * width + right
        walking = walking[y[walking] >= n]
        if not len(walking):
            return y
    raise ValueError("no image inside the range")


def permuted_rows(x: Column, n: Column, seed: int, epoch: Column) -> Column:
    """``permuted`` for numbers from 0 to ``n - 1``, a batch at a time."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            if any(c.null_count for c in columns):
                raise ValueError("numbers, sizes and epochs cannot be null")
            numbers, sizes, epochs = (c.to_numpy(zero_copy_only=False) for c in columns)
            if ((numbers < 0) | (numbers >= sizes)).any():
                raise ValueError("no image inside the range")
            out = np.empty(len(numbers), dtype=np.int64)
            pairs, of = np.unique(np.stack([sizes, epochs]), axis=1, return_inverse=True)
            for at, (size, each) in enumerate(pairs.T.tolist()):
                own = np.nonzero(of.reshape(-1) == at)[0]
                out[own] = permuted_array(numbers[own], size, seed, each)
            yield pa.array(out)

    return run(_whole(x), _whole(n), _whole(epoch))
