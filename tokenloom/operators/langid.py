"""Language identification from character trigrams, as two Spark jobs.

Texts are read as code points in Arrow batches, and a trigram is one number of 63 bits. Counting
folds a batch's trigrams before anything leaves the task. Scoring looks weights up by
position: trigrams of ASCII characters address a table directly, others are searched in a
sorted one, and a text's weights are summed where the text is. No row stands for a
character, and nothing is shuffled but counts. Weights that are too many for a
broadcast are joined to each text's distinct trigrams and their counts instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tokenloom.operators.lookup import lookup_join
from tokenloom.session import materialise

SMOOTHING = 0.5
VOCABULARY = 20_000
#: Weights in a broadcast table, at most; 8 bytes each.
BROADCAST_WEIGHTS = 8_000_000
#: Characters handled at once, but for a longer text, which is handled alone.
SLICE_CHARS = 1 << 20

_BITS = 21  # of a code point
_ASCII = 1 << 7
#: Bits that are set in a trigram's number if one of its characters is beyond ASCII.
_BEYOND = ~sum((_ASCII - 1) << shift for shift in (2 * _BITS, _BITS, 0))


def trigrams(text: Column, max_chars: int | None = None) -> Column:
    """Lower-cased character trigrams as an array; for small inputs and checks."""
    sample = text if max_chars is None else F.substring(text, 1, max_chars)
    return F.regexp_extract_all(F.lower(sample), F.lit("(?s)(?=(...))"), F.lit(1))


def _lowered(text: Column, max_chars: int | None) -> Column:
    return F.lower(text if max_chars is None else F.substring(text, 1, max_chars))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_CHARS`` bytes of text each."""
    start, held = 0, 0
    for row, size in enumerate(pc.binary_length(texts).to_pylist()):
        held += size or 0
        if held >= SLICE_CHARS:
            yield start, row + 1
            start, held = row + 1, 0
    if start < len(texts):
        yield start, len(texts)


def trigram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of several texts as numbers, one after another, and how many each text has."""
    whole = "".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(whole, dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(t or "") for t in texts], dtype=np.int64)
    counts = np.maximum(lengths - 2, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.int64), counts
    codes = points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]
    # Places whose trigram would reach into the next text.
    inside = np.ones(len(points), dtype=bool)
    ends = np.cumsum(lengths)
    for back in (1, 2):
        last = (ends - back)[lengths >= back]
        inside[last] = False
    return codes[inside[:-2]], counts


def _ascii_places(codes: np.ndarray) -> np.ndarray:
    """Numbers below ``_ASCII**3`` for trigrams of ASCII characters: seven bits of each."""
    return codes >> 28 | codes >> 14 & 0x3F80 | codes & 0x7F


def _spelt(code: int) -> str:
    return "".join(chr(code >> shift & (1 << _BITS) - 1) for shift in (2 * _BITS, _BITS, 0))


def _code(tri: str) -> int:
    a, b, c = map(ord, tri)
    return a << 2 * _BITS | b << _BITS | c


def trigram_counts(
    labelled: DataFrame, *, lang: str = "lang", text: str = "text", max_chars: int | None = None
) -> DataFrame:
    """``(lang, tri, n)``: the training table. A null language is one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                langs = batch.column(0).slice(low, high - low).to_pylist()
                texts = batch.column(1).slice(low, high - low).to_pylist()
                codes, counts = trigram_codes(texts)
                names = sorted(set(langs), key=lambda x: (x is not None, x))
                number = {name: i for i, name in enumerate(names)}
                owner = np.repeat([number[x] for x in langs], counts)
                for name in names:
                    found, n = np.unique(codes[owner == number[name]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(found), pa.string()),
                            pa.array([_spelt(c) for c in found.tolist()], pa.string()),
                            pa.array(n, pa.int64()),
                        ],
                        ["lang", "tri", "n"],
                    )

    rows = labelled.select(
        F.col(lang).cast("string").alias("lang"), _lowered(F.col(text), max_chars).alias("text")
    )
    partial = rows.mapInArrow(run, "lang string, tri string, n long")
    return partial.groupBy("lang", "tri").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageProfile:
    """Trained weights: one row per trigram, one log-probability column per language."""

    weights: DataFrame
    languages: list[str]
    unseen: dict[str, float]


def train_profile(
    labelled: DataFrame, *, max_chars: int | None = None, lang: str = "lang", text: str = "text"
) -> LanguageProfile:
    """Count once, keep the counts as a table, and turn them into weights.

    Only one total per language comes to the driver.
    """
    counts = materialise(
        trigram_counts(labelled, lang=lang, text=text, max_chars=max_chars), "trigrams"
    )
    totals = (
        counts.groupBy("lang")
        .agg(F.sum("n").alias("n"))
        .orderBy("lang")
        .collect()
    )
    languages = [row["lang"] for row in totals]
    mass = {row["lang"]: row["n"] + SMOOTHING * VOCABULARY for row in totals}
    weights = (
        counts.groupBy("tri")
        .pivot("lang", languages)
        .agg(F.sum("n"))
        .select(
            "tri",
            *[
                F.ln(
                    (F.coalesce(F.col(f"`{l}`"), F.lit(0)) + F.lit(SMOOTHING)) / F.lit(mass[l])
                ).alias(f"w{i}")
                for i, l in enumerate(languages)
            ],
        )
    )
    unseen = {l: math.log(SMOOTHING / mass[l]) for l in languages}
    return LanguageProfile(materialise(weights, "language-weights"), languages, unseen)


class WeightTable:
    """Weights by place: the last row is that of a trigram nobody has seen."""

    def __init__(self, trigrams: list[str], weights: np.ndarray, unseen: list[float]):
        codes = np.array([_code(t) for t in trigrams], dtype=np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        # A row for each language, so that a text's weights are summed along the row.
        self.weights = np.ascontiguousarray(np.vstack([weights[order], unseen]).T)
        # ASCII trigrams address their row directly.
        self.direct = np.full(_ASCII**3, len(codes), dtype=np.int32)
        plain = (self.codes & _BEYOND) == 0
        self.direct[_ascii_places(self.codes[plain])] = np.nonzero(plain)[0]

    def places(self, codes: np.ndarray) -> np.ndarray:
        plain = (codes & _BEYOND) == 0
        if plain.all():
            return self.direct[_ascii_places(codes)]
        out = self.direct[np.where(plain, _ascii_places(codes), 0)]
        others = np.nonzero(~plain)[0]
        if len(others) and len(self.codes):
            spot = np.minimum(np.searchsorted(self.codes, codes[others]), len(self.codes) - 1)
            known = self.codes[spot] == codes[others]
            out[others] = np.where(known, spot, len(self.codes))
        elif len(others):
            out[others] = len(self.codes)
        return out

    def sums(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Summed weights of every text with a trigram, a column per language."""
        starts = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
        places = self.places(codes)
        return np.stack([np.add.reduceat(w[places], starts) for w in self.weights], axis=1)


def identify(
    docs: DataFrame,
    profile: LanguageProfile,
    *,
    keys: list[str],
    text: str = "text",
    max_chars: int | None = None,
) -> DataFrame:
    """``(*keys, language)``, one row per input row: the likeliest language of its text.

    Texts without a trigram get NULL. Weights are looked up where the text is, and no
    text is shuffled. ``keys`` may include further narrow columns that should stay with
    the row; beyond the size of a broadcast they have to identify it.
    """
    wanted = docs.select(F.struct(*keys).alias("row"), _lowered(F.col(text), max_chars).alias("text"))
    most = BROADCAST_WEIGHTS // max(1, len(profile.languages))
    if profile.weights.limit(most + 1).count() > most:
        return _identify_by_join(wanted, profile, keys)
    held = profile.weights.toArrow()
    columns = [held[f"w{i}"].to_numpy() for i in range(len(profile.languages))]
    table = WeightTable(
        held["tri"].to_pylist(),
        np.stack(columns, axis=1) if columns else np.zeros((held.num_rows, 0)),
        [profile.unseen[l] for l in profile.languages],
    )
    shared = docs.sparkSession.sparkContext.broadcast(table)
    # Of equal scores the last name counts, so the first best is looked for from the end.
    names = pa.array([*reversed(profile.languages), None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                part = batch.slice(low, high - low)
                codes, counts = trigram_codes(part.column(1).to_pylist())
                best = np.full(part.num_rows, len(names) - 1, dtype=np.int64)
                if len(codes) and len(names) > 1:
                    best[counts > 0] = np.argmax(shared.value.sums(codes, counts)[:, ::-1], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.column(0).flatten(), names.take(pa.array(best))], [*keys, "language"]
                )

    kept = [StructField(f.name, f.dataType) for f in wanted.schema["row"].dataType.fields]
    return wanted.mapInArrow(run, StructType([*kept, StructField("language", StringType())]))


def _identify_by_join(wanted: DataFrame, profile: LanguageProfile, keys: list[str]) -> DataFrame:
    """Each text's distinct trigrams and their counts, joined with salted weights."""
    fields = wanted.schema["row"].dataType.fields
    schema = StructType(
        [
            *[StructField(f.name, f.dataType) for f in fields],
            StructField("tri", StringType()),
            StructField("c", LongType()),
            StructField("part", IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                part = batch.slice(low, high - low)
                codes, counts = trigram_codes(part.column(1).to_pylist())
                owner = np.repeat(np.arange(part.num_rows), counts)
                order = np.lexsort((codes, owner))
                codes, owner = codes[order], owner[order]
                new = np.ones(len(codes), dtype=bool)
                new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
                first = np.nonzero(new)[0]
                n = np.diff([*first, len(codes)]).astype(np.int64)
                rows = owner[first]
                spelt = [_spelt(c) for c in codes[first].tolist()]
                empty = np.nonzero(counts == 0)[0]  # kept, with no trigram
                at = pa.array(np.concatenate([rows, empty]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.take(at) for c in part.column(0).flatten()],
                        pa.array([*spelt, *[None] * len(empty)], pa.string()),
                        pa.array(np.concatenate([n, np.zeros(len(empty), np.int64)])),
                        pa.array(np.arange(len(at), dtype=np.int32)),
                    ],
                    [*keys, "tri", "c", "part"],
                )

    counted = wanted.mapInArrow(run, schema)
    scored = lookup_join(counted, profile.weights, ["tri"], spread_by=F.col("part"), max_cells=0)
    sums = scored.groupBy(*keys).agg(
        F.sum("c").alias("n_tri"),
        *[
            F.sum(F.col("c") * F.coalesce(F.col(f"w{i}"), F.lit(profile.unseen[l]))).alias(f"s{i}")
            for i, l in enumerate(profile.languages)
        ],
    )
    candidates = F.array(
        *[
            F.struct(F.col(f"s{i}").alias("score"), F.lit(l).alias("lang"))
            for i, l in enumerate(profile.languages)
        ]
    )
    best = F.when(F.col("n_tri") > 0, F.array_max(candidates)["lang"])
    return sums.select(*keys, best.alias("language"))
