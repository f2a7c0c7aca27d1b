"""Byte-level BPE: Spark higher-order functions fold ranked merges over distinct words.

Three steps run in one task, without a shuffle:

1. texts are cut by the split pattern; a word's first occurrence in the task gets the next
   number, and a block row carries its documents as numbers and the new words as arrays of
   single-byte ids. Under ``SPACED_PATTERN`` the units between single spaces are cut once each
   and remembered, so that a text takes a look into a table for each unit;
2. a higher-order function folds the merges over each new word's array: every step finds the
   adjacent pair of the lowest rank, the leftmost on a tie, and replaces it. Ranks come from a
   literal map in the plan. Spark searches a map literal from front to back, which takes longer
   than a word's whole fold, so the map is laid out as two constant arrays that are addressed
   by the ids of a pair;
3. documents are put together from their words' ids, and decoded by concatenating the binary
   pieces of the ids.

Rows of a partition keep their order through the steps, on which the numbering relies. The
table of numbered words is bounded and starts anew when it is full. Two workers run for every
task, so the last step holds its words end to end in arrays. Words that are a piece
themselves need no fold; those of more than ``LONG_WORD`` bytes would make it quadratic and
are merged with a heap in step 1.

A null or empty text has no ids and decodes to nothing. Row ids may be null or repeated;
columns other than id and text are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_WORD = 48
BLOCK_DOCS = 64
NUMBERED_WORDS = 300_000
KNOWN_UNITS = 200_000
#: A pattern that starts a new word at every space between two characters that are none, and
#: looks no further than past the white space behind a word.
SPACED_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_POSITION_BITS = 20
#: Differs from every left id in the bits from 16 up.
_NO_ENTRY = 1 << 33


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file; a piece's rank is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """``left << 16 | right`` to the id of their concatenation, for all pairs that merge."""
    if len(ranks) > 1 << 16:
        raise ValueError("ids have to fit 16 bits")
    found = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                found[left << 16 | right] = rank
    return found


def literal_map(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """The rank map as two arrays: ``shift`` by left id, and ``entries``.

    The rank of a pair stands in ``entries`` at ``shift[left] + right``, behind the left id
    in the bits from 16 up. Rows of pairs with the same left id are laid into each other's
    gaps, longest row first.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for key, rank in pairs.items():
        rows.setdefault(key >> 16, []).append((key & 0xFFFF, rank))
    widest = 1 + max((key & 0xFFFF for key in pairs), default=0)
    used = np.zeros(4 * widest + 16 * len(pairs), dtype=bool)
    shift = [0] * (1 + max(rows, default=0))
    placed: dict[int, int] = {}

    def place(left: int, at: int) -> None:
        shift[left] = at
        for right, rank in rows[left]:
            used[at + right] = True
            placed[at + right] = left << 16 | rank

    at, length = 0, 0
    for left in sorted((x for x in rows if len(rows[x]) > 1), key=lambda x: (-len(rows[x]), x)):
        rights = np.array([right for right, _ in rows[left]])
        # Long rows are laid from left to right; each length of short ones, from the start.
        if length != len(rights) and len(rights) <= 8:
            at = 0
        length, near = len(rights), np.arange(max(64, 16_384 // len(rights)))
        while (taken := used[(at + near)[:, None] + rights].any(axis=1)).all():
            at += len(near)
        at += int(np.argmin(taken))
        place(left, at)
    # A row of one pair fits any free place.
    gaps = map(int, widest + np.flatnonzero(~used[widest:]))
    for left in sorted(x for x in rows if len(rows[x]) == 1):
        place(left, next(gaps) - rows[left][0][0])
    entries = [placed.get(i, _NO_ENTRY) for i in range(max(shift) + 1 + (1 << 16))]
    return shift + [0] * ((1 << 16) - len(shift)), entries


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def fold_merges(ids: Column, tables: tuple[list[int], list[int]]) -> Column:
    """Merge an array of byte ids until no adjacent pair has a rank."""
    # Written by their difference from a free place, of which there are many: the literal is short.
    shift, entries = _constant(tables[0]), _constant([e ^ _NO_ENTRY for e in tables[1]])

    def ranked(state: Column, left: Column, i: Column) -> Column:
        """Rank and position of the pair at ``i``; above all ranks if it does not merge."""
        at = F.get(shift, left.cast("int")) + F.get(state, i + 1)
        # Equal left ids cancel out, and the rank is left.
        found = F.get(entries, at.cast("int")).bitwiseXOR(F.lit(_NO_ENTRY))
        rank = found.bitwiseXOR(F.shiftleft(left, 16))
        return F.shiftleft(rank, _POSITION_BITS) + i

    def replace(state: Column, best: Column) -> Column:
        at = best.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
        merged = F.array(F.shiftright(best, _POSITION_BITS))
        rest = F.slice(state, at + 3, F.size(state))
        return F.concat(F.slice(state, F.lit(1), at), merged, rest)

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(F.transform(state, lambda left, i: ranked(state, left, i)))
        # A one-element array binds the best pair to a name.
        chosen = F.transform(
            F.array(best),
            lambda b: F.when(b < (1 << (16 + _POSITION_BITS)), replace(state, b)).otherwise(state),
        )
        return F.element_at(chosen, 1)

    return F.aggregate(ids, ids, step)


def merge_with_heap(ids: list[int], rank_of: Callable[[int, int], int | None]) -> list[int]:
    """The same merges for one long word, in order of rank and position."""
    after = [*range(1, len(ids)), -1]
    before = [-1, *range(len(ids) - 1)]
    alive = [True] * len(ids)
    ids = list(ids)
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := rank_of(ids[i], ids[j])) is not None:
            heapq.heappush(queue, (rank, i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while queue:
        rank, i, left, right = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x, keep in zip(ids, alive) if keep]


def _lists(values: list) -> pa.Array:
    """Arrays of ints as one list column of long."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _one_row(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


BLOCK = "restart boolean, ids array<long>, counts array<long>, refs binary, words array<array<long>>, unmerged array<boolean>"


def _units(text: str, units_of: Callable[[str], list[str]] | None) -> tuple[str, list[str], str]:
    """A text as its first unit, those behind a single space each, and a last one with its space.

    A space is single if no white space is next to it. The first and the last unit can have
    white space at their outer ends, those between begin and end with another character.
    """
    if units_of is None:
        return text, [], ""
    units = text.split(" ")
    # Wider than the pattern's white space: at worst a text is cut again by the pattern's own.
    if not all(units) or any(map(str.isspace, [u[0] for u in units[1:]])) or any(
        map(str.isspace, [u[-1] for u in units[:-1]])
    ):
        units = units_of(text)
    return units[0], units[1:-1], " " + units[-1] if len(units) > 1 else ""


def _number_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Block rows: documents as word numbers, and the words that are new in this task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        units_of = regex.compile(r"(?<=\S) (?=\S)").split if pattern == SPACED_PATTERN else None
        find_rank = shared.value.get
        pieces = {i: p for p, i in shared.value.items()}

        def rank_of(left: int, right: int) -> int | None:
            return find_rank(pieces[left] + pieces[right])

        # Words and units by the little-endian numbers of their words.
        number: dict[str, bytes] = {}
        seen: dict[str, bytes] = {}
        restart = True
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                texts = [_units(t or "", units_of) for t in part.column(1).to_pylist()]
                if len(number) > NUMBERED_WORDS:
                    number, seen, restart = {}, {}, True
                elif len(seen) > KNOWN_UNITS:
                    seen = {}
                cuts = {u: split(" " + u) for u in set().union(*(x[1] for x in texts)).difference(seen)}
                ends = [(split(first), split(last)) for first, _, last in texts]
                new = set().union(*cuts.values(), *(x for pair in ends for x in pair))
                new = list(new.difference(number))
                number.update(
                    (word, n.to_bytes(4, "little")) for n, word in enumerate(new, len(number))
                )
                find, find_unit = number.__getitem__, seen.__getitem__
                seen.update((u, b"".join(map(find, x))) for u, x in cuts.items())
                words, unmerged = [], []
                for word in new:
                    data = word.encode()
                    known = find_rank(data)
                    ids = np.array([known]) if known is not None else single[list(data)]
                    if len(ids) > LONG_WORD:
                        ids = np.array(merge_with_heap(ids.tolist(), rank_of))
                        unmerged.append(False)
                    else:
                        unmerged.append(known is None)
                    words.append(ids)
                refs = [
                    b"".join([*map(find, a), *map(find_unit, middle), *map(find, z)])
                    for (a, z), (_, middle, _) in zip(ends, texts)
                ]
                columns = [
                    pa.array([restart]),
                    _one_row(part.column(0)),
                    _one_row(pa.array([len(r) // 4 for r in refs], pa.int64())),
                    pa.array([b"".join(refs)], pa.binary()),
                    _one_row(_lists(words)),
                    _one_row(pa.array(unmerged, pa.bool_())),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["restart", "ids", "counts", "refs", "words", "unmerged"]
                )
                restart = False

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, BLOCK)


class _Joined:
    """Lists of numbers, kept end to end in arrays that double when they are full."""

    def __init__(self, dtype: str):
        self.values, self.ends = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int32)
        self.n = 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        low, n = int(self.ends[self.n]), self.n + len(lengths)
        self.values = self._room(self.values, low + len(values))
        self.ends = self._room(self.ends, n + 1)
        self.values[low : low + len(values)] = values
        self.ends[self.n + 1 : n + 1] = low + np.cumsum(lengths)
        self.n = n

    @staticmethod
    def _room(held: np.ndarray, needed: int) -> np.ndarray:
        if needed <= len(held):
            return held
        wider = np.zeros(max(needed, 2 * len(held)), held.dtype)
        wider[: len(held)] = held
        return wider

    def take(self, numbers: pa.Array, stops: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The lists of the given numbers in a row, and where ``stops`` of them end."""
        ends = pa.array(self.ends[: self.n + 1])
        found = pa.ListArray.from_arrays(ends, pa.array(self.values[: self.ends[self.n]])).take(numbers)
        return found.flatten(), found.offsets.take(pa.array(stops))


def _assemble(blocks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Documents' ids and decoded bytes from block rows with encoded words."""
    by_id = [b""] * (1 + max(ranks.values()))
    for piece, i in ranks.items():
        by_id[i] = piece
    shared = blocks.sparkSession.sparkContext.broadcast(pa.array(by_id, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        sizes = pc.binary_length(pieces).to_numpy()
        codes, decoded = _Joined("int32"), _Joined("uint8")
        for batch in batches:
            for row in range(batch.num_rows):
                restart, ids, counts, refs, words = (batch.column(i)[row] for i in range(5))
                if restart.as_py():
                    codes, decoded = _Joined("int32"), _Joined("uint8")
                lengths = words.values.value_lengths().to_numpy(zero_copy_only=False)
                flat = words.values.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                codes.add(flat, lengths)
                # Sums of the pieces' sizes up to every word's end.
                ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum(lengths)]
                text = b"".join(pieces.take(pa.array(flat)).to_pylist())
                decoded.add(np.frombuffer(text, np.uint8), np.diff(ends, prepend=0))
                numbers = pa.array(np.frombuffer(refs.as_py(), dtype="<i4"))
                stops = np.cumsum([0, *counts.as_py()])
                tokens, ends = codes.take(numbers, stops)
                texts, bounds = decoded.take(numbers, stops)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.ListArray.from_arrays(ends, tokens),
                        pa.Array.from_buffers(
                            pa.binary(), len(stops) - 1, [None, bounds.buffers()[1], texts.buffers()[1]]
                        ),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return blocks.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every whole text: its token ids and what they decode to."""
    ranks = read_ranks(ranks_path)
    tables = literal_map(pair_ranks(ranks))
    blocks = _number_words(docs, ranks, pattern)
    folded = F.transform(
        F.arrays_zip("words", "unmerged"),
        lambda w: F.when(w["unmerged"], fold_merges(w["words"], tables)).otherwise(w["words"]),
    )
    return _assemble(blocks.select("restart", "ids", "counts", "refs", folded.alias("codes")), ranks)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``tokens`` with ``decoded``: the concatenated binary pieces of the array ``ids``."""
    pieces = {i: p for p, i in read_ranks(ranks_path).items()}

    @F.pandas_udf("binary")
    def join(ids):
        return ids.map(lambda x: b"".join(pieces[i] for i in x) if x is not None else b"")

    return tokens.withColumn("decoded", join("ids"))
