"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations of the product of their pieces, which
a forward pass over its bytes gives exactly; a text's is the product over its words,
since no piece crosses a word. Piece probabilities are learned by expectation and
maximisation over the distinct words of a hash sample of about ``FIT_DOCS`` documents per
language: expected counts are computed and summed in Spark, and one number per piece and
language reaches the driver.

Words are runs of letters in lower case, as UTF-8 bytes behind a space. Byte pieces make
every word segmentable. Scoring is one scan without a shuffle; a worker keeps a bounded
table of words it has seen.

A null text, or one without a letter, is ``und`` with score 0. A null ``lang`` teaches
nothing. Without anything to learn from every text is ``und``. Equal scores go to the
smaller language code. A row without an id is learned from as if its id were empty.
Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialise

FIT_DOCS = 800
ROUNDS = 4
SMOOTHING = 0.05
UNDETERMINED = "und"
CACHED_WORDS = 300_000
#: Probabilities are scaled by this factor per byte, so that whole words fit a double.
PER_BYTE = 1000.0
#: Longer words, and those with sums below ``SMALLEST``, are passed over in rescaled steps.
LONG_WORD = 64
SMALLEST = 1e-250
#: Words of more bytes are scored, but not learned from.
TAUGHT_BYTES = 4096

LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """All pieces of a vocabulary file, their numbers, and a trie of those that fit into words."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            found = {base64.b64decode(line.split()[0]) for line in lines}
        found |= {bytes([b]) for b in range(256)}
        self.__setstate__(sorted(found))

    def __getstate__(self) -> list[bytes]:
        """Only the pieces travel; a worker builds the trie anew."""
        return list(self.number)

    def __setstate__(self, ordered: list[bytes]) -> None:
        self.number = {p: i for i, p in enumerate(ordered)}
        self.length = np.array([len(p) for p in ordered])
        # A space stands in front of a word only; no other ASCII byte than these is in one.
        inner = frozenset([*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
        fit = [p for p in ordered if inner.issuperset(p.removeprefix(b" "))]
        self.longest = max(map(len, fit))
        self._class = np.zeros(256, dtype=np.int64)
        used = sorted({b for p in fit for b in p})
        self._class[used] = np.arange(1, len(used) + 1)
        node = {b"": 0}
        for p in fit:
            for n in range(1, len(p) + 1):
                node.setdefault(p[:n], len(node))
        #: Next node by node and class of the byte, 0 where there is none.
        self._next = np.zeros((len(node), len(used) + 1), dtype=np.int32)
        #: Number of the piece that ends at a node, or -1.
        self._piece = np.array([self.number.get(p, -1) for p in node], dtype=np.int32)
        for p, at in node.items():
            if p:
                self._next[node[p[:-1]], self._class[p[-1]]] = at

    def __len__(self) -> int:
        return len(self.number)

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every piece that occurs in a word, by end and start.

        The trie is walked from all positions of all words at once.
        """
        sizes = np.array([len(x) for x in words])
        first = np.cumsum(sizes) - sizes
        letters = self._class[np.frombuffer(b"".join(words), dtype=np.uint8)]
        left = np.repeat(first + sizes, sizes)
        begin = np.arange(len(letters))
        node, found = np.zeros(len(letters), dtype=np.int32), []
        at = begin
        while len(at):
            node = self._next[node, letters[at]]
            piece = self._piece[node]
            ends = (node > 0) & (piece >= 0)
            found.append((begin[ends], at[ends] + 1, piece[ends]))
            on = (node > 0) & (at + 1 < left[begin])
            begin, node, at = begin[on], node[on], at[on] + 1
        start, end, piece = (np.concatenate(column) for column in zip(*found))
        word = np.repeat(np.arange(len(words)), sizes)[start]
        start, end = start - first[word], end - first[word]
        order = np.lexsort((start, end))
        return word[order], start[order], end[order], piece[order].astype(np.int64)


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a whole text; none if it has no letter at all."""
    words = LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return []
    return [b" " + w.encode("utf-8", "surrogatepass") for w in words]


def _runs(major: np.ndarray, minor: np.ndarray) -> list[int]:
    """Where the pair of values changes; between two such places every word occurs once."""
    new = np.flatnonzero((np.diff(major) != 0) | (np.diff(minor) != 0)) + 1
    return [0, *new.tolist(), len(major)]


def _forward(words: list[bytes], edges: tuple, weight: np.ndarray) -> np.ndarray:
    """Scaled sums over all segmentations of every prefix, ``[position, word, language]``.

    ``weight`` is ``[edge, language]``.
    """
    w, start, end, _ = edges
    alpha = np.zeros((max(map(len, words)) + 1, len(words), weight.shape[1]))
    alpha[0] = 1.0
    cuts = _runs(end, start)
    for a, b in zip(cuts, cuts[1:]):
        alpha[end[a], w[a:b]] += alpha[start[a], w[a:b]] * weight[a:b]
    return alpha


def _backward(words: list[bytes], edges: tuple, weight: np.ndarray) -> np.ndarray:
    """Scaled sums over all segmentations of every suffix."""
    w, start, end, _ = edges
    lengths = np.array([len(x) for x in words])
    beta = np.zeros((lengths.max() + 1, len(words), weight.shape[1]))
    beta[lengths, np.arange(len(words))] = 1.0
    order = np.lexsort((end, -start))
    w, start, end, weight = w[order], start[order], end[order], weight[order]
    cuts = _runs(start, end)
    for a, b in zip(cuts, cuts[1:]):
        beta[start[a], w[a:b]] += beta[end[a], w[a:b]] * weight[a:b]
    return beta


def _too_small(words: list[bytes], sums: np.ndarray) -> np.ndarray:
    """Words with a sum near the smallest doubles at one of their positions."""
    lengths = np.array([len(x) for x in words])
    inside = np.arange(len(sums))[:, None] <= lengths
    return ((sums.min(axis=2) < SMALLEST) & inside).any(axis=0)


def _long_word(pieces: Pieces, word: bytes, scaled: np.ndarray) -> np.ndarray:
    """Logarithm of the scaled sum for one word of any length, rescaling as it goes."""
    rows = np.zeros((pieces.longest + 1, scaled.shape[0]))
    rows[0] = 1.0
    shift = np.zeros(scaled.shape[0])
    step = 4096
    for at in range(0, len(word), step):
        _, start, end, piece = pieces.edges([word[at : at + step + pieces.longest]])
        order = np.argsort(start, kind="stable")
        order = order[start[order] < step]
        begin, size, piece = start[order], (end - start)[order], piece[order]
        cuts = np.searchsorted(begin, np.arange(min(step, len(word) - at) + 1))
        for a, b in zip(cuts, cuts[1:]):
            rows[size[a:b]] += rows[0] * scaled[:, piece[a:b]].T
            top = rows[1:].max(axis=0)
            rows[:-1] = rows[1:] / top
            rows[-1] = 0.0
            shift += np.log(top)
    return np.log(rows[0]) + shift


def _long_uses(pieces: Pieces, word: bytes, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and their expected uses in one word of one language, by sums of logarithms."""
    _, start, end, piece = pieces.edges([word])
    weight = np.log(scaled[piece])
    before, after = np.full((2, len(word) + 1), -np.inf)
    before[0] = after[-1] = 0.0
    for i in range(len(piece)):
        before[end[i]] = np.logaddexp(before[end[i]], before[start[i]] + weight[i])
    for i in np.lexsort((end, -start)):
        after[start[i]] = np.logaddexp(after[start[i]], after[end[i]] + weight[i])
    return piece, np.exp(before[start] + weight + after[end] - after[0])


def log_probabilities(pieces: Pieces, words: list[bytes], prob: np.ndarray) -> np.ndarray:
    """``[word, language]``: log of the sum over all segmentations. ``prob`` is ``[language, piece]``."""
    scaled = prob * PER_BYTE ** np.minimum(pieces.length, pieces.longest)
    weights = np.ascontiguousarray(scaled.T)
    out = np.zeros((len(words), prob.shape[0]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
    slow = sorted(set(range(len(words))).difference(short))
    short.sort(key=lambda i: len(words[i]))
    for at in range(0, len(short), 4096):
        chosen = np.array(short[at : at + 4096])
        part = [words[i] for i in chosen]
        edges = pieces.edges(part)
        alpha = _forward(part, edges, weights[edges[3]])
        small = _too_small(part, alpha)
        last = alpha[[len(w) for w in part], np.arange(len(part))]
        out[chosen[~small]] = np.log(last[~small])
        slow += chosen[small].tolist()
    for i in slow:
        out[i] = _long_word(pieces, words[i], scaled)
    return out - np.array([len(w) for w in words])[:, None] * np.log(PER_BYTE)


def expected_counts(
    pieces: Pieces, words: list[bytes], counts: np.ndarray, prob: np.ndarray
) -> np.ndarray:
    """Expected uses of every piece over all segmentations of counted words of one language."""
    total = np.zeros(len(pieces))
    scaled = prob * PER_BYTE ** np.minimum(pieces.length, pieces.longest)
    sizes = [len(w) for w in words]
    order = [i for i in np.argsort(sizes) if sizes[i] <= LONG_WORD]
    slow = [i for i, size in enumerate(sizes) if LONG_WORD < size <= TAUGHT_BYTES]
    for at in range(0, len(order), 4096):
        chosen = np.array(order[at : at + 4096])
        part = [words[i] for i in chosen]
        edges = pieces.edges(part)
        weight = scaled[edges[3]][:, None]
        alpha, beta = _forward(part, edges, weight), _backward(part, edges, weight)
        small = _too_small(part, alpha) | _too_small(part, beta)
        slow += chosen[small].tolist()
        w, start, end, piece = (column[~small[edges[0]]] for column in edges)
        use = alpha[start, w, 0] * scaled[piece] * beta[end, w, 0] / beta[0, w, 0]
        total += np.bincount(piece, use * counts[chosen][w], len(total))
    for i in slow:
        piece, use = _long_uses(pieces, words[i], scaled)
        total += np.bincount(piece, use * counts[i], len(total))
    return total


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _sample_words(docs: DataFrame, fit_docs: int) -> DataFrame:
    """``(lang, word, n)``: counted words of about ``fit_docs`` documents of every language."""
    known = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    ).where("lang is not null and text is not null")
    known = known.where(~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count()  # one row per language
    cuts = sizes.select("lang", (F.lit(fit_docs) / F.col("count") * (1 << 30)).alias("cut"))
    drawn = known.join(F.broadcast(cuts), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("cut")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["text"].map(word_bytes)
            long = pd.DataFrame({"lang": batch["lang"], "word": words}).explode("word").dropna()
            yield long.groupby(["lang", "word"]).size().reset_index(name="n")

    words = drawn.select("lang", "text").mapInPandas(count, "lang string, word binary, n long")
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame, vocabulary: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS
) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities ``[language, piece]``."""
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(Pieces(vocabulary))
    words = materialise(_sample_words(docs, fit_docs), "unigram-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    prob = np.full((len(langs), len(pieces.value)), 1.0 / len(pieces.value))
    for _ in range(rounds if langs else 0):

        def expect(batches: Iterator[pd.DataFrame], prob: np.ndarray = prob) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lang, group in batch.groupby("lang"):
                    uses = expected_counts(
                        pieces.value, list(group["word"]), group["n"].to_numpy(), prob[langs.index(lang)]
                    )
                    found = np.nonzero(uses)[0]
                    yield pd.DataFrame({"lang": lang, "piece": found, "uses": uses[found]})

        expected = words.mapInPandas(expect, "lang string, piece int, uses double")
        counts = np.full(prob.shape, SMOOTHING)
        for row in expected.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():
            counts[langs.index(row["lang"]), row["piece"]] += row["uses"]
        prob = counts / counts.sum(axis=1, keepdims=True)
    return langs, prob


def predict(
    docs: DataFrame, vocabulary: str, langs: list[str], prob: np.ndarray
) -> DataFrame:
    """``(doc_id, lang_pred, score)``: the likeliest language and its share of the probability."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((Pieces(vocabulary), prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, prob = shared.value
        number: dict[bytes, int] = {}
        rows = np.zeros((1 << 16, len(langs)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [word_bytes(t) for t in part.column(1).to_pylist()]
                if len(number) > CACHED_WORDS:
                    number = {}
                new = list({w for words in texts for w in words if w not in number})
                if new and langs:
                    size = len(number) + len(new)
                    if size > len(rows):
                        rows = np.concatenate([rows, np.zeros((max(len(rows), len(new)), len(langs)))])
                    rows[len(number) : size] = log_probabilities(pieces, new, prob)
                    number.update(zip(new, range(len(number), size)))
                best, scores = [], []
                for words in texts:
                    if not words or not langs:
                        best.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = rows[[number[w] for w in words]].sum(axis=0)
                    top = int(np.argmax(total))
                    best.append(langs[top])
                    scores.append(float(1 / np.exp(total - total[top]).sum()))
                columns = [part.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document."""
    langs, prob = train(docs, vocabulary)
    found = predict(docs, vocabulary, langs, prob)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
