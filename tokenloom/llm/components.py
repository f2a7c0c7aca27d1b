"""Connected components of an edge list, by alternating large and small stars.

Every round is a pair of aggregations and joins over stored edges; nothing but a count
reaches the driver. Edges are rewritten towards the smallest node they reach, so the
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialise

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = materialise(
        both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")), "cc-low"
    )
    return (
        both.where("dst > src").join(least, "src").select(F.col("low").alias("src"), "dst")
    ).where("src < dst")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    # An edge is (smaller, larger); the larger end gathers its smaller neighbours.
    least = materialise(edges.groupBy("dst").agg(F.min("src").alias("low")), "cc-least")
    moved = (
        edges.join(least, "dst")
        .where("src > low")
        .select(F.col("low").alias("src"), F.col("src").alias("dst"))
    )
    own = least.select(F.col("low").alias("src"), "dst")
    return moved.unionByName(own)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of an edge; the component is its smallest node.

    ``edges`` holds two columns ``src`` and ``dst`` of the same ordered type. An empty
    table gives an empty table; loops and repeated edges change nothing.
    """
    ordered = edges.where("src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    )
    current = materialise(ordered.distinct(), "cc-edges")
    for _ in range(MAX_ROUNDS):
        starred = materialise(_small_star(_large_star(current).distinct()).distinct(), "cc-edges")
        # Done when both ends of every edge agree: nobody is a centre and a leaf at once,
        # and no leaf has two centres.
        leaves, rows = starred.agg(F.count_distinct("dst"), F.count("*")).first()
        centres_below = starred.select("src").join(
            starred.select(F.col("dst").alias("src")), "src", "left_semi"
        )
        current = starred
        if leaves == rows and centres_below.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    leaf = current.select(F.col("dst").alias("node"), F.col("src").alias("component"))
    centre = current.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    return leaf.unionByName(centre)
