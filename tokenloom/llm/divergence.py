"""Quality rules by distribution divergence.

Every text becomes two histograms, of character classes and of common words (all other
words share one cell). The texts
that pass the base rules are summed per language into references, over all documents.
A document is kept when its histograms stay within a Jensen-Shannon distance of the
closest reference; a histogram with too few entries is not judged, and the limit of the
words is wider for texts of 100 to 200 words, so that short clean texts are left alone.

A null text has no words and fails the base rule, as does an empty one. A null ``lang``
contributes to no reference, and no document is judged by its own ``lang``. Without any
reference the base rules decide alone. Repeated rows are judged alike and counted as
often as they occur. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tokenloom.session import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document's histogram is judged from this many characters or words on.
MIN_CLASS_CHARS = 600
MIN_COMMON_WORDS = 100
#: A language is a reference from this many words on.
MIN_REFERENCE_WORDS = 1000
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.235
#: Few words scatter more: the limit grows by so much for each word that is missing to so many.
SHORT_SLACK, FULL_WORDS = 0.00044, 200
#: Rows of a batch that are held as Python texts at once.
SLICE_ROWS = 256
#: Rows whose histograms are compared at once.
JUDGED_ROWS = 4096
JUDGED = ("base_failed", "class_distance", "word_distance", "kept")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that it was for on are as with be at by this from".split(),
    "de": "der die und das von den mit ist im nicht ein eine auf als auch dem zu sich".split(),
    "fr": "le la les de des et un une du que qui dans pour par sur pas est au elle".split(),
    "es": "el los las y en una con por para como del se al lo su no es".split(),
}
VOCABULARY = sorted({word for words in COMMON_WORDS.values() for word in words})

CLASSES = ("lower", "upper", "digit", "space", "stop", "other_ascii", "symbol", "beyond_ascii")


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; bytes that continue a character belong to none (-1)."""
    table = np.full(256, CLASSES.index("other_ascii"))
    for name, members in (
        ("lower", range(ord("a"), ord("z") + 1)),
        ("upper", range(ord("A"), ord("Z") + 1)),
        ("digit", range(ord("0"), ord("9") + 1)),
        ("space", [0x20, *range(0x09, 0x0E)]),
        ("stop", map(ord, ".,")),
        ("symbol", map(ord, SYMBOLS)),
        ("beyond_ascii", range(0xC0, 256)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = -1
    return table


_CLASS_OF = np.zeros((256, len(CLASSES)), dtype=np.int64)
for _byte, _class in enumerate(_class_table()):
    if _class >= 0:
        _CLASS_OF[_byte, _class] = 1
_INDEX = {word: i for i, word in enumerate(VOCABULARY)}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside, reached = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            inside += start + 3 - max(start, reached)
            reached = start + 3
    return inside


def text_features(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common words."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif WORD.search(line):
            seen.add(line)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    classes = np.bincount(raw, minlength=256) @ _CLASS_OF
    found = Counter(map(_INDEX.get, WORD.findall(text.translate(_LOWER))))
    common = [found[i] for i in range(len(VOCABULARY))]
    common.append(len(words) - sum(common))
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeated_words(words),
        classes.tolist(),
        common,
    )


FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "classes array<long>, commons array<long>"
)


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang`` and the features of every whole text."""
    names = ["doc_id", "lang", *[c.split()[0] for c in FEATURES.split(", ")]]
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                rows = zip(*[text_features(t.as_py()) for t in part.column(2)])
                columns = [pa.array(c, t) for c, t in zip(rows, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names)

    columns = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    )
    return columns.mapInArrow(compute, f"doc_id long, lang string, {FEATURES}")


def base_failed() -> Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def language_references(features: DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """Summed histograms per language of all documents that pass the base rules.

    One row per language reaches the driver.
    """
    sums = [
        F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(name)
        for name, n in (("classes", len(CLASSES)), ("commons", len(VOCABULARY) + 1))
    ]
    rows = (
        features.where(F.col("lang").isNotNull() & ~base_failed())
        .groupBy("lang")
        .agg(F.sum("n_words").alias("n_words"), *sums)
        .where(F.col("n_words") >= MIN_REFERENCE_WORDS)
        .orderBy("lang")
        .collect()
    )
    return [(r["lang"], r["classes"], r["commons"]) for r in rows]


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two arrays of shares."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def js_distances(histograms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distance of every histogram to the closest reference, as ``js_distance`` has it."""
    shares = lambda h: h / np.maximum(h.sum(axis=1, keepdims=True), 1)
    p, least = shares(histograms), np.full(len(histograms), np.inf)
    for q in shares(references):
        both = p + q
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log2(2 * p / both), 0.0)
            terms += np.where(q > 0, q * np.log2(2 * q / both), 0.0)
        np.minimum(least, np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0)), out=least)
    return least


def verdicts(
    words: np.ndarray,
    repeated: np.ndarray,
    classes: np.ndarray,
    commons: np.ndarray,
    references: list[tuple[str, list[int], list[int]]],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``JUDGED`` for the features of some texts; distances are 0 without references."""
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
    class_distance = word_distance = np.zeros(len(words))
    if references:
        of = lambda at: np.array([r[at] for r in references], dtype=np.float64)
        class_distance, word_distance = js_distances(classes, of(1)), js_distances(commons, of(2))
    limits = MAX_WORD_DISTANCE + SHORT_SLACK * np.maximum(FULL_WORDS - words, 0)
    class_ok = (classes.sum(axis=1) < MIN_CLASS_CHARS) | (class_distance <= MAX_CLASS_DISTANCE)
    word_ok = (words < MIN_COMMON_WORDS) | (word_distance <= limits)
    return failed, class_distance, word_distance, ~failed & class_ok & word_ok


def judge(
    features: DataFrame, references: list[tuple[str, list[int], list[int]]]
) -> DataFrame:
    """Features with ``base_failed``, both distances to the closest reference, and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, JUDGED_ROWS):
                part = batch.slice(low, JUDGED_ROWS)
                column = lambda name: part.column(names.index(name))
                cells = lambda name: column(name).flatten().to_numpy().reshape(len(part), -1)
                figures = verdicts(
                    column("n_words").to_numpy(), column("n_repeat_words").to_numpy(),
                    cells("classes"), cells("commons"), references,
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(x) for x in figures)], [*names, *JUDGED]
                )

    names = features.columns
    fields = [StructField(n, BooleanType() if n in ("base_failed", "kept") else DoubleType()) for n in JUDGED]
    return features.mapInArrow(run, StructType([*features.schema.fields, *fields]))


def quality(docs: DataFrame) -> DataFrame:
    """Features and verdict of every document; the features are stored between the two passes."""
    features = materialise(document_features(docs), "divergence-features")
    return judge(features, language_references(features))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and no shuffle of texts.

    References come from a first pass over all documents; the second pass judges each row
    where its text is, in slices, so that a text crosses to Python once.
    """
    references = language_references(materialise(document_features(docs), "divergence-features"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                texts = part.column(at).cast(pa.string())
                rows = [text_features(t.as_py()) for t in texts]
                columns = [np.array([r[i] for r in rows]) for i in (0, 4, 5, 6)]
                yield part.filter(pa.array(verdicts(*columns, references)[-1]))

    return docs.mapInArrow(run, docs.schema)


def check_sql() -> str:
    """The same rows from DuckDB; ``doc_id`` has to be unique there."""
    char_sets = {
        "lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": ".,",
        "symbol": "#*$%&|<>", "beyond_ascii": r"\x{80}-\x{10FFFF}",
    }
    counts = {c: f"length(regexp_replace(t, '[^{s}]', '', 'g'))" for c, s in char_sets.items()}
    counts["other_ascii"] = "length(t) - " + " - ".join(counts.values())
    classes = ", ".join(counts[c] for c in CLASSES)
    commons = ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))" for w in VOCABULARY)
    n = {"classes": len(CLASSES), "commons": len(VOCABULARY) + 1}
    sums = ", ".join(
        f"[{', '.join(f'sum({c}[{i}])' for i in range(1, k + 1))}] AS {c}" for c, k in n.items()
    )

    def distance(column: str) -> str:
        p, q = (f"{t}.{column}[i] / greatest(list_sum({t}.{column}), 1)" for t in "fr")
        half = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        both = half.format(a=f"({p})", b=f"({q})") + " + " + half.format(a=f"({q})", b=f"({p})")
        cells = f"list_transform(range(1, {n[column] + 1}), lambda i: ({both}) / 2)"
        return f"min(sqrt(greatest(list_sum({cells}), 0)))"

    return f"""
    WITH w AS (
        SELECT doc_id, lang, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
        FROM documents
    ), u AS (
        SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
    ), g AS (
        SELECT doc_id, i, word || ' ' || lead(word) OVER a || ' ' || lead(word, 2) OVER a AS g
        FROM u WINDOW a AS (PARTITION BY doc_id ORDER BY i)
    ), c AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL
    ), r AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM c, (VALUES (0), (1), (2)) AS steps(k) WHERE c > 1 GROUP BY doc_id
    ), b AS (
        SELECT doc_id, lang, t, len(ws) AS n_words,
               coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words,
               list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lw
        FROM w LEFT JOIN r USING (doc_id)
    ), s AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
               [{classes}] AS classes, [{commons}] AS known
        FROM b
    ), f AS (SELECT *, list_append(known, (n_words - list_sum(known))::BIGINT) AS commons FROM s),
    r2 AS (
        SELECT lang, {sums} FROM f WHERE lang IS NOT NULL AND NOT base_failed
        GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE_WORDS}
    ), d AS (
        SELECT f.doc_id, {distance("classes")} AS class_distance, {distance("commons")} AS word_distance
        FROM f, r2 AS r GROUP BY f.doc_id
    )
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed
           AND (list_sum(classes) < {MIN_CLASS_CHARS} OR coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE})
           AND (n_words < {MIN_COMMON_WORDS} OR coalesce(word_distance, 0)
                <= {MAX_WORD_DISTANCE}::DOUBLE + {SHORT_SLACK}::DOUBLE * greatest({FULL_WORDS} - n_words, 0)) AS kept
    FROM f LEFT JOIN d USING (doc_id)
    """
