"""Hard negatives of anchors, scored along spanning trees of the anchors.

Vectors become integers, ``floor(256 * x)``, and a score is their integer inner product. The
anchors of a label are dealt to blocks of bounded size, near ones together, and every
block becomes a minimum spanning tree. Candidates are read where they are stored: a task
scores them at a tree's root, and at every further anchor the parent's score plus or minus
edge length times candidate norm bounds the child's. Only candidates whose bounds overlap
the child's window are scored again; all others carry their widened bounds on. Where an
edge is so long that its bounds could exclude nothing, it is cut, and the child is a root
of its own. Bounds decide what is computed, never the result.

Two passes over the candidates serve one batch of trees: the first finds each anchor's
best rows of its own label (window: from the last one kept so far), the second the best
rows of other labels inside the windows that these positives open. What leaves a task is
a few rows per anchor. Batches are of bounded size and follow one another, so no
broadcast grows with the table.

Rows without id, label or vector take no part, nor do vectors with a null or non-finite
component, of another length than the most frequent one, or so long that scores need not
fit 64 bits (scaled components of 2**31 in sum). Rows that are equal in id, label and
vector are one row; rows that share only their id are separate ones. An anchor never
meets a row of its own id. Ties go to the smaller id. A table without anchors or
candidates gives an empty result. Columns other than the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import materialise, scratch_path

SCALE = 256
TREE_ANCHORS = 512
#: Anchors whose trees are broadcast for one batch of two passes.
BATCH_ANCHORS = 16_384
#: Edges longer than this share of the child's norm bound nothing and are cut.
LONG_EDGE = 0.6
CHUNK_ROWS = 8192
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``, whole numbers kept in double precision."""
    return np.floor(SCALE * np.asarray(vectors, dtype=np.float64))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (parents first), parent of each point (-1: a root) and edge length, by Prim's rule."""
    n = len(points)
    squares = (points**2).sum(axis=1)
    norms = np.sqrt(squares)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    nearest, via = np.full(n, np.inf), np.full(n, -1)
    inside = np.zeros(n, dtype=bool)
    at = 0
    for step in range(n):
        order[step], inside[at] = at, True
        distance = np.sqrt(np.maximum(squares - 2 * points @ points[at] + squares[at], 0))
        closer = distance < nearest
        nearest[closer], via[closer] = distance[closer], at
        if step + 1 < n:
            at = int(np.argmin(np.where(inside, np.inf, nearest)))
            # The length is measured again on the difference: squares cancel badly.
            length = float(np.linalg.norm(points[at] - points[via[at]]))
            if length <= LONG_EDGE * norms[at]:
                parent[at], edge[at] = via[at], length
    return order, parent, edge


@dataclass
class Tree:
    """Anchors of one label, parents before children."""

    label: int
    ids: np.ndarray
    points: np.ndarray
    parent: np.ndarray
    edge: np.ndarray

    @classmethod
    def grow(cls, label: int, ids: np.ndarray, points: np.ndarray) -> Tree:
        order, parent, edge = spanning_tree(points)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        moved = parent[order]
        moved = np.where(moved < 0, -1, place[moved])
        return cls(label, ids[order], points[order], moved, edge[order])

    def scores(
        self, rows: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(anchors, rows, scores)`` of all pairs whose score can lie from ``low`` to ``high``.

        Pairs left out lie outside their anchor's window for certain.
        """
        kind = exact_kind(norms, self.points)
        held, points = rows.astype(kind), self.points.astype(kind)
        roots = np.nonzero(self.parent < 0)[0]
        at_roots = held @ points[roots].T
        hit, which = np.nonzero((at_roots >= low[roots]) & (at_roots <= high[roots]))
        yield roots[which], hit, at_roots[hit, which].astype(np.int64)
        children_left = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, root in enumerate(roots):
            if children_left[root]:
                exact = at_roots[:, at].astype(np.float64)
                bounds[root] = (exact, exact)
        for child in np.nonzero(self.parent >= 0)[0]:
            parent = self.parent[child]
            # One more on either side covers the rounding of the product.
            reach = self.edge[child] * norms * (1 + 1e-9) + 1
            least, most = bounds[parent][0] - reach, bounds[parent][1] + reach
            open_ = np.nonzero((most >= low[child]) & (least <= high[child]))[0]
            again = held[open_] @ points[child]
            inside = (again >= low[child]) & (again <= high[child])
            found = open_[inside]
            yield np.full(len(found), child), found, again[inside].astype(np.int64)
            children_left[parent] -= 1
            if not children_left[parent]:
                del bounds[parent]
            if children_left[child]:
                least[open_] = most[open_] = again
                bounds[child] = (least, most)


def exact_kind(norms: np.ndarray, points: np.ndarray) -> type:
    """A number type in which every partial sum of an inner product is exact."""
    most = norms.max(initial=0) * np.linalg.norm(points, axis=1).max(initial=0)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def fingerprints(rows: np.ndarray) -> np.ndarray:
    """64 bits of every vector, to tell rows that share an id."""
    weights = np.random.default_rng(1).integers(1, 2**62, rows.shape[1]) * 2 + 1
    with np.errstate(over="ignore"):
        return (rows.astype(np.int64) * weights).sum(axis=1)


def participants(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Ids, labels and integer vectors of the rows of ``(vec_id, label, embedding)`` that take part."""
    ids, labels, vectors = batch.columns
    known = ids.is_valid().to_numpy(False) & labels.is_valid().to_numpy(False)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(False)
    known &= sizes == width
    chosen = vectors.filter(pa.array(known))
    flat = chosen.flatten()
    values = flat.to_numpy(False).astype(np.float64, copy=False).reshape(-1, width)
    if flat.null_count:  # a null among numbers; told from NaN only to be left out alike
        values = np.where(flat.is_valid().to_numpy(False).reshape(-1, width), values, np.nan)
    with np.errstate(over="ignore", invalid="ignore"):
        values = integers(values)
        fit = np.isfinite(values).all(axis=1) & (np.abs(values).sum(axis=1) < 2**31)
    ids = ids.to_numpy(False)[known][fit].astype(np.int64)
    labels = labels.to_numpy(False)[known][fit].astype(np.int64)
    return ids, labels, values[fit]


def best(frame: pd.DataFrame, group: list[str], k: int) -> pd.DataFrame:
    """The first ``k`` different rows of every group: higher scores first, then smaller ids."""
    frame = frame.drop_duplicates([*group, "vec_id", "mark"])
    frame = frame.sort_values(
        [*group, "score", "vec_id", "mark"], ascending=[True] * len(group) + [False, True, True]
    )
    return frame[frame.groupby(group, sort=False).cumcount() < k]


def first_of(df: DataFrame, group: list[str], k: int) -> DataFrame:
    """``best`` over the partial results of all tasks, with the place as ``rank``."""
    by = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id", "mark")
    alike = Window.partitionBy(*group, "vec_id", "mark").orderBy("score")
    once = df.withColumn("_n", F.row_number().over(alike)).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def pieces(own: np.ndarray) -> Iterator[np.ndarray]:
    """A few rows first: the last one kept of them already excludes most of the others."""
    for low, high in ((0, 64), (64, 1024), (1024, len(own))):
        if low < len(own):
            yield own[low:high]


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bounded pieces ``(ids, labels, vectors, norms, marks)`` of what a task reads."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            ids, labels, rows = participants(batch.slice(at, CHUNK_ROWS), width)
            if len(ids):
                yield ids, labels, rows, np.linalg.norm(rows, axis=1), fingerprints(rows)


def positive_pass(trees, first: list[int], width: int, k: int):
    """Worker of the first pass: the best ``k`` rows of its own label for every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [None] * len(trees.value)
        floors = [np.full(len(t.ids), -np.inf) for t in trees.value]
        for ids, labels, rows, norms, marks in chunks(batches, width):
            for number, tree in enumerate(trees.value):
                for own in pieces(np.nonzero(labels == tree.label)[0]):
                    anchors, hits, scores = map(
                        np.concatenate,
                        zip(*tree.scores(rows[own], norms[own], floors[number], _no_limit(tree))),
                    )
                    hits = own[hits]
                    other = ids[hits] != tree.ids[anchors]
                    anchors, hits, scores = anchors[other], hits[other], scores[other]
                    found = pd.DataFrame(
                        {"node": anchors, "vec_id": ids[hits], "mark": marks[hits], "score": scores}
                    )
                    if held[number] is not None:
                        found = pd.concat([held[number], found])
                    held[number] = found = best(found, ["node"], k)
                    full = found.groupby("node")["score"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    floors[number][full.index] = full["min"]
        for number, found in enumerate(held):
            if found is not None and len(found):
                found = found.assign(node=found["node"] + first[number])
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return run


def _no_limit(tree: Tree) -> np.ndarray:
    return np.full(len(tree.ids), np.inf)


def negative_pass(trees, windows, first: list[int], width: int, k: int):
    """Worker of the second pass: the best ``k`` rows of other labels in each positive's window.

    ``windows`` holds per tree the arrays ``(anchor, place, low, high)`` of the windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [None] * len(trees.value)
        outer = []
        for tree, (anchor, _, low, high) in zip(trees.value, windows.value):
            least, most = np.full(len(tree.ids), np.inf), np.full(len(tree.ids), -np.inf)
            np.minimum.at(least, anchor, low)
            np.maximum.at(most, anchor, high)
            outer.append((least, most))
        for ids, labels, rows, norms, marks in chunks(batches, width):
            for number, tree in enumerate(trees.value):
                other = np.nonzero(labels != tree.label)[0]
                if not len(other) or not len(windows.value[number][0]):
                    continue
                anchors, hits, scores = map(
                    np.concatenate, zip(*tree.scores(rows[other], norms[other], *outer[number]))
                )
                hits = other[hits]
                differs = ids[hits] != tree.ids[anchors]
                anchors, hits, scores = anchors[differs], hits[differs], scores[differs]
                found = _in_windows(
                    anchors, ids[hits], marks[hits], scores, windows.value[number], k
                )
                if held[number] is not None:
                    found = pd.concat([held[number], found])
                held[number] = best(found, ["node", "place"], k)
        for number, found in enumerate(held):
            if found is not None and len(found):
                found = found.assign(node=found["node"] + first[number])
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return run


def _in_windows(anchors, ids, marks, scores, windows, k: int) -> pd.DataFrame:
    """The best of every window of a chunk, taken from its anchor's sorted scores."""
    frame = pd.DataFrame({"anchor": anchors, "vec_id": ids, "mark": marks, "score": scores})
    frame = frame.drop_duplicates(["anchor", "vec_id", "mark"])
    order = np.lexsort((frame["mark"], frame["vec_id"], -frame["score"], frame["anchor"]))
    frame = frame.iloc[order]
    owner, falling = frame["anchor"].to_numpy(), -frame["score"].to_numpy()
    anchor, place, low, high = windows
    begin, end = np.searchsorted(owner, anchor), np.searchsorted(owner, anchor, side="right")
    picked, node, at_place = [], [], []
    for a, p, lo, hi, b, e in zip(anchor, place, low, high, begin, end):
        start = b + np.searchsorted(falling[b:e], -hi)
        stop = min(start + k, b + np.searchsorted(falling[b:e], -lo, side="right"))
        if stop > start:
            picked.append(np.arange(start, stop))
            node += [a] * (stop - start)
            at_place += [p] * (stop - start)
    rows = frame.iloc[np.concatenate(picked)] if picked else frame.iloc[:0]
    return pd.DataFrame(
        {
            "node": np.array(node, dtype=np.int64),
            "place": np.array(at_place, dtype=np.int64),
            "vec_id": rows["vec_id"].to_numpy(),
            "mark": rows["mark"].to_numpy(),
            "score": rows["score"].to_numpy(),
        }
    )


def anchor_trees(anchors: DataFrame, width: int) -> DataFrame:
    """``(tree, label, ids, parent, edge, points)``: one row per block of anchors, stored.

    Blocks are cut along one fixed direction, so that near anchors stay together, and
    by a hash where a cut is still too large, as among copies.
    """
    direction = np.random.default_rng(0).standard_normal(width)
    along = F.aggregate(
        F.zip_with("v", F.array(*[F.lit(float(x)) for x in direction]), lambda a, b: a * b),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # Shares of unit vectors along a direction are near to normal; uneven blocks are cut again.
    share = 1 / (1 + F.exp(-1.702 * F.coalesce(F.try_divide(along, length), F.lit(0.0))))
    counted = anchors.groupBy("label").agg(
        F.ceil(F.count("*") / (TREE_ANCHORS // 2)).cast("int").alias("cuts")
    )
    keys = ["label", "cut"]
    dealt = anchors.join(counted, "label").withColumn(
        "cut", F.least(F.floor(share * F.col("cuts")).cast("int"), F.col("cuts") - 1)
    )
    sizes = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / TREE_ANCHORS).cast("int").alias("parts"))
    dealt = dealt.join(sizes, keys).withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    )

    def grow(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable")
        points = integers(np.stack(block["v"].to_numpy()))
        tree = Tree.grow(int(block["label"].iloc[0]), block["vec_id"].to_numpy(), points)
        return pd.DataFrame(
            {
                "label": [tree.label],
                "n": [len(tree.ids)],
                "first_id": [int(tree.ids.min())],
                "ids": [tree.ids.astype("<i8").tobytes()],
                "parent": [tree.parent.astype("<i8").tobytes()],
                "edge": [tree.edge.astype("<f8").tobytes()],
                "points": [tree.points.astype("<f8").tobytes()],
            }
        )

    schema = (
        "label long, n long, first_id long, ids binary, parent binary, edge binary, points binary"
    )
    grown = dealt.groupBy(*keys, "part").applyInPandas(grow, schema)
    return materialise(grown, "anchor-trees")


def _tree(row, width: int) -> Tree:
    whole = lambda data: np.frombuffer(data, "<i8").copy()
    points = np.frombuffer(row["points"], "<f8").reshape(-1, width).copy()
    return Tree(
        row["label"], whole(row["ids"]), points, whole(row["parent"]),
        np.frombuffer(row["edge"], "<f8").copy(),
    )


def _window(positive: int) -> tuple[int, int] | None:
    """Whole scores ``s`` with ``50 p <= 100 s <= 95 p``, if any."""
    low, high = -(-50 * positive // 100), 95 * positive // 100
    return (low, high) if low <= high else None


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 3,
    id_column: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """Negatives of every anchor and positive: ``(anchor_id, positive_id, rank, negative_id, ...)``.

    ``anchors`` is a condition on ``vec_id`` that says which rows are anchors. A negative
    scores from 50 to 95 percent of the positive.
    """
    spark = rows.sparkSession
    given = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).alias("embedding"),
    )
    known = given.where("vec_id is not null and label is not null and embedding is not null")
    v = F.col("embedding").cast("array<double>")
    scaled = F.transform(v, lambda x: F.floor(x * SCALE))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))
    length = F.when(finite, F.size(v))
    widths = known.groupBy(length.alias("n")).count().where("n is not null and n > 0")
    most = widths.orderBy(F.desc("count"), "n").first()
    if most is None:
        return spark.createDataFrame([], RESULT)
    width = most["n"]
    fits = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.abs(x)) < 2.0**31
    chosen = known.where(anchors).where((length == width) & fits)
    forest = anchor_trees(
        chosen.select("vec_id", "label", v.alias("v")).distinct(), width
    )
    path = scratch_path(spark, "negatives")
    # One small row per tree: where each batch begins.
    sizes = forest.select("label", "first_id", "n").orderBy("label", "first_id").toLocalIterator()
    batches, room = [], 0
    for row in sizes:
        if not batches or room + row["n"] > BATCH_ANCHORS:
            batches.append([(row["label"], row["first_id"])] * 2)
            room = 0
        room += row["n"]
        batches[-1] = [batches[-1][0], (row["label"], row["first_id"])]
    if not batches:
        return spark.createDataFrame([], RESULT)
    place = F.struct("label", "first_id")
    for low, high in batches:
        ends = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("first_id")) for a, b in (low, high)]
        held = forest.where((place >= ends[0]) & (place <= ends[1])).orderBy("label", "first_id")
        trees = [_tree(r, width) for r in held.collect()]
        _batch(known, trees, width, positives, negatives).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _batch(
    known: DataFrame, trees: list[Tree], width: int, positives: int, negatives: int
) -> DataFrame:
    """The result for one batch of trees: two passes over the candidates."""
    spark = known.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    first = np.cumsum([0, *[len(t.ids) for t in trees]]).tolist()
    partial = "node long, vec_id long, mark long, score long"
    found = known.mapInArrow(positive_pass(shared, first, width, positives), partial)
    # Bounded by the batch: so many rows per anchor.
    chosen = first_of(found, ["node"], positives).select("node", "rank", "vec_id", "score").collect()
    per_tree: list[list[tuple]] = [[] for _ in trees]
    facts = []
    for row in chosen:
        window = _window(row["score"])
        if window is None:
            continue
        number = int(np.searchsorted(first, row["node"], side="right")) - 1
        at = row["node"] - first[number]
        per_tree[number].append((at, row["rank"], *window))
        facts.append((row["node"], row["rank"], int(trees[number].ids[at]), row["vec_id"], row["score"]))
    windows = spark.sparkContext.broadcast(
        [
            tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(w))) if w else (np.array([], np.int64),) * 4
            for w in per_tree
        ]
    )
    found = known.mapInArrow(
        negative_pass(shared, windows, first, width, negatives),
        "node long, place long, vec_id long, mark long, score long",
    )
    ranked = first_of(found, ["node", "place"], negatives)
    asked = spark.createDataFrame(
        pd.DataFrame(facts, columns=["node", "place", "anchor_id", "positive_id", "positive_score"])
        if facts
        else [],
        "node long, place long, anchor_id long, positive_id long, positive_score long",
    )
    return ranked.join(F.broadcast(asked), ["node", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def check_sql() -> str:
    """The same rows from DuckDB; ids have to be unique there."""
    return """
    WITH known AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
               list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
        FROM known a JOIN known r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           (row_number() OVER w)::INTEGER AS rank
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
         AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 3
    """
