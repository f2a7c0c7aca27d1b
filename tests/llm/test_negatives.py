"""Hard negatives against brute force, bounds of the trees, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5, positives=5, wanted=3):
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or not len(vector):
            continue
        if any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)
        known[vec_id, label, whole] = None
    found = []
    for anchor, label, a in known:
        if anchor % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(a, v)), i, other)
            for i, other, v in known
            if i != anchor
        ]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            found += [
                (anchor, positive, n + 1, i, -p, -s)
                for n, (s, i, _) in enumerate(sorted(fits)[:wanted])
            ]
    return sorted(found)


def run(df, every=5):
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted(tuple(r[n] for n in names) for r in got.collect())


def vectors(n, width=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    points = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, width))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return [(i, [float(x) for x in p], int(rng.integers(0, 4))) for i, p in enumerate(points)]


def test_equals_brute_force(spark):
    rows = vectors(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = run(df)
    assert got == brute(rows) and len(got) > 100


def test_small_blocks_and_batches(spark, monkeypatch):
    rows = vectors(300, seed=3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(negatives, "TREE_ANCHORS", 8)
    monkeypatch.setattr(negatives, "BATCH_ANCHORS", 20)
    assert run(df) == brute(rows)


def test_bounds_spare_most_scores_among_near_anchors():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    anchors = negatives.integers((centre + rng.normal(0, 0.02, (50, 64))) / 8)
    rows = negatives.integers(rng.standard_normal((4000, 64)) / 8)
    norms = np.linalg.norm(rows, axis=1)
    tree = negatives.Tree.grow(0, np.arange(50), anchors)
    assert (tree.parent < 0).sum() == 1 and (tree.parent < np.arange(50)).all()
    exact = rows @ tree.points.T
    low, high = np.full(50, 20_000.0), np.full(50, 30_000.0)
    calls = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            calls.append(self.shape[0] * (other.shape[1] if other.ndim > 1 else 1))
            return np.asarray(self) @ other

        def astype(self, kind):
            return np.asarray(self).astype(kind).view(Counted)

    parts = list(tree.scores(rows.view(Counted), norms, low, high))
    pairs = {(a, r): s for part in parts for a, r, s in zip(*part)}
    inside = np.argwhere((exact >= 20_000) & (exact <= 30_000))
    assert pairs == {(a, r): exact[r, a] for r, a in inside}
    assert sum(calls) < 0.3 * exact.size


def test_odd_rows(spark):
    good = vectors(60, width=4, seed=7)
    odd = [
        (None, [1.0, 0.0, 0.0, 0.0], 1),
        (100, None, 1),
        (105, [1.0, 0.0, 0.0, 0.0], None),
        (110, [float("nan"), 0.0, 0.0, 0.0], 1),
        (115, [float("inf"), 0.0, 0.0, 0.0], 1),
        (120, [None, 0.0, 0.0, 0.0], 1),
        (125, [], 1),
        (130, [0.0, 0.0, 0.0, 0.0], 1),
        (135, [-1.0, 0.0, 0.0, 0.0], 2),
        good[3], good[10], good[10],
        (20, [0.5, 0.5, 0.5, 0.5], 1),
    ]
    rows = good + odd
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert run(df) == brute(rows)
    clashing = df.selectExpr("*", "1 AS node", "2 AS mark", "3 AS score", "4 AS v", "5 AS rank")
    assert run(clashing) == brute(rows)


def test_other_lengths_take_no_part(spark):
    rows = vectors(40, width=4)
    df = spark.createDataFrame([*rows, (200, [1.0, 2.0], 1)], SCHEMA)
    assert run(df) == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []
    assert run(spark.createDataFrame([(5, [1.0], 1)], SCHEMA)) == []


@pytest.mark.parametrize("scale", [1.0, 3e4, 5e5])
def test_exact_at_every_magnitude(spark, scale):
    rows = [(i, [x * scale for x in v], label) for i, v, label in vectors(50, width=4, seed=9)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
