"""Computed permutations: a permutation for every size, seed and epoch, and its inverse."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import permutation
from tokenloom.functions.permutation import ROUNDS, permuted, unpermuted


def plain(x, n, seed, epoch):
    width = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    height = max(1, -(-n // width))
    while True:
        left, right = divmod(x, width)
        for number in range(ROUNDS):
            digit = left if number % 2 else right
            h = int(hashlib.md5(f"{seed}-{epoch}-{number}-{digit}".encode()).hexdigest()[:8], 16)
            if number % 2:
                right = (right + h) % width
            else:
                left = (left + h) % height
        x = left * width + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1001])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(3))).alias("epoch"))
    size = F.lit(n)
    there = rows.withColumn("y", permuted(F.col("id"), size, 1337, F.col("epoch")))
    got = there.withColumn("back", unpermuted(F.col("y"), size, 1337, F.col("epoch"))).collect()
    assert all(r["back"] == r["id"] and r["y"] == plain(r["id"], n, 1337, r["epoch"]) for r in got)
    for epoch in (0, 3):
        assert sorted(r["y"] for r in got if r["epoch"] == epoch) == list(range(n))
    if n > 10:
        assert [r["y"] for r in got if r["epoch"] == 0] != [r["y"] for r in got if r["epoch"] == 3]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1001])
def test_rows_get_the_same_images_from_hashed_digits(spark, n, monkeypatch):
    rows = spark.range(2 * n).select(
        (F.col("id") % n).alias("row"), F.when(F.col("id") < n, 0).otherwise(3).alias("epoch")
    )
    place = permutation.permuted_rows(F.col("row"), F.lit(n), 1337, F.col("epoch"))
    got = rows.select("row", "epoch", place.alias("y")).collect()
    assert all(r["y"] == plain(r["row"], n, 1337, r["epoch"]) for r in got)
    # A hash for every digit, not for every number.
    hashes = []
    md5 = hashlib.md5
    monkeypatch.setattr(permutation.hashlib, "md5", lambda *a, **k: hashes.append(1) or md5(*a, **k))
    permutation._digit_tables.cache_clear()
    permutation.permuted_array(permutation.np.arange(n), n, 1337, 9)
    permutation.permuted_array(permutation.np.arange(n), n, 1337, 9)
    assert len(hashes) <= ROUNDS * (math.isqrt(n) + 1)
