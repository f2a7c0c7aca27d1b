"""Near-duplicates by SimHash and an inverted index of byte positions.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most
two bits share at least six of them - the guaranteed minimum. A list of one positional
byte would hold a 256th of all fingerprints, so the index is keyed by six positions and
their bytes at once, 28 lists for every distinct fingerprint: a pair meets in a list
exactly when its tally of shared bytes reaches six. The two bytes that a list leaves open
bound it to 65,536 members. Inside a list the open bytes are tallied, pairs of eight and
seven shared bytes included, and every retained pair is verified bit by bit; what leaves
the list is a spanning forest of its links, never the pairs.

Equal texts have equal fingerprints and are folded before the index is built, so a large
group of copies is one entry of it. Links between fingerprints become components by
minimum labels over stored edges.

A null text counts as empty. A text without words has fingerprint zero and is linked like
any other. Rows without an id are linked too; their component is null when no row of it
has an id. Repeated rows share fingerprint and component. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.components import connected
from tokenloom.llm.shingles import near_copies, text_hash
from tokenloom.session import materialise

MAX_BITS = 2
SHINGLE = 3
SEED = 42
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: A list of up to so many members is tallied as one matrix, a longer one by its open bytes.
MATRIX = 512

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Pairs of byte positions left open, 28 of them.
OPEN = list(combinations(range(BYTES), MAX_BITS))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a whole text, as an unsigned 64-bit integer."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").translate(_LOWER))]
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())),
            dtype=np.uint64,
            count=len(starts),
        )
    # Summed in steps, so that the unpacked bits of a long text stay small.
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        raw = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every document; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed, pa.int64())], ["doc_id", "fp"]
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _positional_lists(distinct: DataFrame) -> DataFrame:
    """Every fingerprint under its 28 keys: which two positions are open, and the other six bytes."""
    keys = []
    for at, (i, j) in enumerate(OPEN):
        free = (0xFF << (8 * (7 - i))) | (0xFF << (8 * (7 - j)))
        kept = ~free & 0xFFFF_FFFF_FFFF_FFFF
        signed = kept - (1 << 64) if kept >= 1 << 63 else kept
        keys.append(
            F.struct(
                F.lit(at).cast("byte").alias("open"),
                F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("shared"),
            )
        )
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, -1), axis=-1).sum(
        axis=-1
    )


def _pairs_of_list(members: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a list's members that share enough bytes and differ in few bits.

    ``first`` and ``second`` are the two open positions; the members agree on the others.
    """
    a = (members >> np.uint64(8 * (7 - first))) & np.uint64(0xFF)
    b = (members >> np.uint64(8 * (7 - second))) & np.uint64(0xFF)
    if len(members) <= MATRIX:
        shared = (BYTES - 2) + (a[:, None] == a).astype(np.int8) + (b[:, None] == b)
        left, right = np.nonzero(np.triu(shared >= MIN_SHARED, 1))
    else:
        rest = ((a << np.uint64(8)) | b).astype(np.int64)
        at = np.full(1 << 16, -1, dtype=np.int64)
        at[rest] = np.arange(len(rest))
        single = [1 << k for k in range(16)]
        masks = single + [x | y for x, y in combinations(single, 2)]
        found = [(np.arange(len(rest)), at[rest ^ m]) for m in masks]
        left = np.concatenate([x[y > x] for x, y in found])
        right = np.concatenate([y[y > x] for x, y in found])
    near = _popcount(members[left] ^ members[right]) <= MAX_BITS
    return left[near], right[near]


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` members reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def similar_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints that connect all that are similar."""
    lists = (
        _positional_lists(distinct)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("members"))  # at most 65,536 by construction
        .where(F.size("members") > 1)
        .select(F.col("key.open").alias("open"), "members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for which, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                members = np.sort(members.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                left, right = _pairs_of_list(members, *OPEN[which])
                if len(left):
                    label = _forest(len(members), left, right)
                    moved = np.nonzero(label != np.arange(len(label)))[0]
                    src.append(members[label[moved]])
                    dst.append(members[moved])
            if src:
                columns = [np.concatenate(x).view(np.int64) for x in (src, dst)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["src", "dst"]
                )

    return lists.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every document."""
    prints = materialise(fingerprints(docs), "simhash-fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    distinct = materialise(distinct, "simhash-distinct")
    edges = materialise(similar_fingerprints(distinct.select("fp")), "simhash-edges")
    labels = connected(edges)
    in_group = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component")
    )
    smallest = in_group.withColumn(
        "component_id", F.min("first_doc").over(Window.partitionBy("component"))
    )
    # Stored, so that the join below has two plain exchanges and a hot fingerprint is split.
    smallest = materialise(smallest.select("fp", "component_id"), "simhash-components")
    return prints.join(smallest, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies, with all its columns: the smallest id.

    Near copies have five-word shingles of similarity 0.8 or more; fingerprints within two
    bits, the contract of ``near_duplicates``, find next to none of them. Rows that share an id
    but not their text are compared like others; of rows equal in both one stays. Rows without
    an id are not compared and all stay.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    classes = near_copies(known.select("doc_id", "text"))
    keepers = classes.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    keepers = keepers.select("kept.*").distinct()
    # The whole row in one column, so that no name of its own can clash.
    rows = known.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_hash().alias("text_hash"),
    )
    held = rows.join(keepers, ["doc_id", "text_hash"], "left_semi")
    held = held.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    return held.unionByName(docs.where(F.col("doc_id").isNull()))
