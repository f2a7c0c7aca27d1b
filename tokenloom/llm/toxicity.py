"""Toxicity by compression distance.

Two zstandard dictionaries share the same ordinary content. One goes on with what is
over-represented in toxic text, the other with as many bytes that match nothing. A
window of a few words is compressed with both; the bytes that the toxic dictionary
saves are the window's distance. A document's windows are summed up in a few figures,
and a calibrated logistic threshold turns them into a score.

Dictionaries and calibration are fitted on the driver from a bounded sample: of each
class the ``FIT_DOCS`` labelled documents with the smallest hash of their id, texts
above ``FIT_BYTES`` left out. Every document is scored, over its whole text.

A null or empty text has no windows and gets the score of a document without any
distance. Rows without an id are scored and never learned from. A document labelled
more than once counts as toxic if one label says so. Without labels of both classes
every score is 0. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FIT_DOCS = 4000
FIT_BYTES = 65_536
WINDOW_WORDS = 12
ORDINARY_BYTES = 8192
TOXIC_BYTES = 8192
#: A word is telling when at least so many unrelated toxic documents hold it, and so many
#: times the share of ordinary documents.
MIN_TOXIC_DOCS = 5
MIN_TOXIC_SHARE = 0.006
MIN_RATIO = 15.0
#: Documents that share more of their words than this are kin.
MAX_KINSHIP = 0.4
#: Rows of a batch that are held as Python texts at once.
SLICE_ROWS = 256
THRESHOLD = 0.7
#: Toxic documents are the exception, and clean ones are to be left alone.
TOXIC_PRIOR = 0.15
FOLDS = 2

#: Windows are counted that save at least so many bytes.
SAVINGS = (3, 5, 7, 9)
FIGURES = 3 + 2 * len(SAVINGS)

_STRIP = ".,!?;:\"'()[]%&*$#|<>"
_COMPRESSION = zstandard.ZstdCompressionParameters(
    window_log=17,
    chain_log=16,
    hash_log=15,
    search_log=6,
    min_match=6,
    target_length=64,
    strategy=zstandard.STRATEGY_LAZY2,
    write_content_size=False,
    write_checksum=False,
    write_dict_id=False,
)


@dataclass
class ToxicityModel:
    """Dictionary contents and the calibrated weights of the window figures."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    bias: float


def windows(text: str) -> list[bytes]:
    """Groups of ``WINDOW_WORDS`` words of the whole text in lower case."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    starts = range(0, len(words), WINDOW_WORDS)
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in starts]


class Distance:
    """Bytes per window that the toxic dictionary saves over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # Bytes that never occur in UTF-8 keep all offsets of the shared part alike.
        noise = np.random.default_rng(0).integers(0xF8, 0x100, len(toxic)).astype(np.uint8)
        self._plain, self._toxic = (
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(
                    ordinary + tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                compression_params=_COMPRESSION,
            ).compress
            for tail in (noise.tobytes(), toxic)
        )

    def figures(self, text: str | None) -> list[float]:
        """Largest saving, mean of the largest two and three, and how many windows save how much."""
        cut = windows(text or "")
        if not cut:
            return [0.0] * FIGURES
        n = len(cut)
        plain = np.fromiter(map(len, map(self._plain, cut)), dtype=np.int64, count=n)
        saved = plain - np.fromiter(map(len, map(self._toxic, cut)), dtype=np.int64, count=n)
        top = np.minimum(np.sort(saved)[::-1], 16)
        counts = [int((saved >= least).sum()) for least in SAVINGS]
        return [
            float(top[0]),
            float(top[:2].mean()),
            float(top[:3].mean()),
            *np.log1p(counts).tolist(),
            *[c / n for c in counts],
        ]


def _words(text: str) -> set[str]:
    return {w for w in (x.strip(_STRIP) for x in text.lower().split()) if len(w) > 2}


def _kin(text: str) -> int:
    """The smallest hash of a text's word triples: alike for near copies, else different."""
    words = text.lower().split()
    triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in triples)


def _unrelated(vocabularies: list[set[str]], wanted: float) -> bool:
    """Whether at least so many documents hold mostly words of their own."""
    chosen: list[set[str]] = []
    for words in vocabularies:
        if all(len(words & c) <= MAX_KINSHIP * min(len(words), len(c)) for c in chosen):
            chosen.append(words)
            if len(chosen) >= wanted:
                return True
    return False


def toxic_content(toxic: list[str], ordinary: list[str]) -> bytes:
    """Words that toxic text favours, most telling last, where the compressor finds them first.

    Near copies of a document count once.
    """
    single = lambda texts: {_kin(t): t for t in texts}.values()
    vocabularies = [{sys.intern(w) for w in _words(text)} for text in single(toxic)]
    held = Counter(w for words in vocabularies for w in words)
    floor = max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * max(1, len(vocabularies)))
    frequent = {word for word, n in held.items() if n >= floor}
    # Of ordinary documents only the counts of these words are kept.
    plain, usual = single(ordinary), Counter()
    for text in plain:
        usual.update(_words(text) & frequent)
    sizes = [max(1, len(plain)), max(1, len(vocabularies))]
    favoured = {
        word: []
        for word in frequent
        if held[word] / sizes[1] > MIN_RATIO * (usual[word] + 0.5) / sizes[0]
    }
    for words in vocabularies:
        for word in words & favoured.keys():
            favoured[word].append(words)
    telling = [
        (held[word], word) for word, found in favoured.items() if _unrelated(found, floor)
    ]
    content = b""
    for _, word in sorted(telling, reverse=True):
        piece = f" {word} ".encode("utf-8", "surrogatepass")
        if len(content) + len(piece) > TOXIC_BYTES:
            break
        content = piece + content
    return content


def ordinary_content(ordinary: list[str]) -> bytes:
    samples = [w for text in ordinary for w in windows(text)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, k=32, d=6, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:ORDINARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Logistic regression of the figures, with ``TOXIC_PRIOR`` as the share of toxic documents."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = (x - x.mean(axis=0)) / scale
    share = np.where(
        y == 1, TOXIC_PRIOR / max(1, (y == 1).sum()), (1 - TOXIC_PRIOR) / max(1, (y == 0).sum())
    )
    z1 = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.diag([1e-4] * x.shape[1] + [1e-9])
    w1 = np.zeros(x.shape[1] + 1)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z1 @ w1, -30, 30)))
        slope = z1.T @ ((p - y) * share) + ridge @ w1
        bend = (z1 * (p * (1 - p) * share)[:, None]).T @ z1 + ridge
        w1 -= np.linalg.solve(bend, slope)
    w, b = w1[:-1], w1[-1]
    return (w / scale).tolist(), float(b - (w * x.mean(axis=0) / scale).sum())


def train(rows: list[tuple[int, str, int]]) -> ToxicityModel | None:
    """Fit on ``(doc_id, text, toxic)``; None without documents of both classes.

    Calibration scores each half of the rows with dictionaries of the other half.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1]))

    def contents(part: list[tuple[int, str, int]]) -> tuple[bytes, bytes]:
        plain = [t for _, t, y in part if not y]
        return ordinary_content(plain), toxic_content([t for _, t, y in part if y], plain)

    if len({y for _, _, y in rows}) < 2:
        return None
    # Near copies fall into the same half.
    fold = [_kin(t) % FOLDS for _, t, _ in rows]
    figures = np.zeros((len(rows), FIGURES))
    for k in range(FOLDS):
        distance = Distance(*contents([r for r, f in zip(rows, fold) if f != k]))
        for i, (_, text, _) in enumerate(rows):
            if fold[i] == k:
                figures[i] = distance.figures(text)
    weights, bias = _logistic(figures, np.array([y for _, _, y in rows]))
    return ToxicityModel(*contents(rows), weights, bias)


def _id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learned from."""
    return F.crc32(_id_text(doc_id)) % 3 == 1


def fit_sample(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> list[tuple]:
    """``(doc_id, text, toxic)`` of at most ``2 * fit_docs`` labelled documents."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(fit_docs)
    chosen = chosen.unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(fit_docs))
    # Bounded by fit_docs, so it may be broadcast whatever the size of the corpus.
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
        .where(F.length(F.trim("text")) > 0)
        .where(F.octet_length("text") <= FIT_BYTES)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", "toxic")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    return [(r["doc_id"], r["text"], r["toxic"]) for r in found.collect()]


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """All columns of ``docs``, with ``tox_score`` in front of them as the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        weights = np.array(model.weights)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                x = np.array([distance.figures(t) for t in texts]) @ weights + model.bias
                values = pa.array(1 / (1 + np.exp(-x)), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [values, *batch.columns[1:]], ["tox_score", *batch.schema.names[1:]]
                )

    if model is None:
        return docs.select(F.lit(0.0).alias("tox_score"), "*")
    wide = docs.select(F.col("text").cast("string").alias("_tox_text"), "*")
    schema = StructType([StructField("tox_score", DoubleType()), *docs.schema.fields])
    return wide.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Rows are dropped where they are scored, in slices, so that a text crosses to Python once.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        weights = np.array(model.weights)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                texts = part.column(at).cast(pa.string())
                x = np.array([distance.figures(t.as_py()) for t in texts]) @ weights + model.bias
                yield part.filter(pa.array(1 / (1 + np.exp(-x)) < THRESHOLD))

    return docs if model is None else docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    model = train(fit_sample(docs, labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
