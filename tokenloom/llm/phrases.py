"""Collocations by partitioned mining: frequent in a shard, then counted everywhere.

Texts of one language are dealt to shards that fit in a worker's memory. Every shard is mined
completely, for phrases whose local count reaches the global support lowered in proportion
to the shard's bytes: a phrase below its local support in every shard cannot reach the
support in all. Of the union of what is locally frequent, a phrase stays a candidate while the
counts that shards report, and what the others hide below their support, may reach the support
together. Shards are mined for pairs first, and for longer phrases where all pairs are such
candidates. A phrase that no shard can hide has its count by then; the others are counted
exactly in a second pass over all texts. Counts, cuts and scores are plain joins and
aggregates afterwards.

Candidates reach the counting pass as a broadcast trie of at most ``BATCH_PHRASES`` phrases;
more of them are counted in further passes, split by their first two words. A shard that
grows beyond its size is mined as several. Local support falls to one where a language has
over ``support`` full shards: all pairs are reported then, but longer phrases only where their
pairs are frequent everywhere (about eight times ``shard_bytes`` is held by a worker).

``A-Z`` are lower-cased; texts are cut into pieces at ``.,;:!?`` and line breaks, and pieces
into words at spaces and tabs. A null text is empty; a null language is ``und``. Equal rows
count as often as they occur, ids are not used for counting, and further columns are
ignored. Without a frequent phrase, or in an empty table, the result is empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.lookup import lookup_join
from tokenloom.session import materialise, scratch_path, spread

SUPPORT = 100
MAX_WORDS = 5
TOP = 2000
UNKNOWN_LANG = "und"

#: Texts of one shard, in bytes.
SHARD_BYTES = 48 << 20
#: A smaller language is still cut into so many shards, but not below the least size.
SPREAD_SHARDS = 12
LEAST_SHARD_BYTES = 1 << 20
BATCH_PHRASES = 1_000_000
#: Text handled at once while words are numbered or counted.
STEP_BYTES = 4 << 20
EMIT_ROWS = 50_000

_BREAK = b"\xff"  # never part of UTF-8
_LOWER = bytearray(range(256))
for _byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_byte] = _byte + 32
for _byte in b".,;:!?\x0a\x0b\x0c\x0d":
    _LOWER[_byte] = _BREAK[0]
_LOWER = bytes(_LOWER)


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of several texts in a row, with a break between pieces and between texts."""
    joined = _BREAK.join(texts).translate(_LOWER)
    return joined.replace(_BREAK, b" \xff ").split()


def prepared(docs: DataFrame) -> DataFrame:
    """``(lang, text, size)``: every row, the text as bytes."""
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        F.col("doc_id").alias("doc_id"),
    ).withColumn("size", F.octet_length("text").cast("long"))


def steps(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch's texts (column ``at``) of bounded size: first row and texts."""
    held, size, start = [], 0, 0
    for row, text in enumerate(batch.column(at)):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= STEP_BYTES:
            yield start, held
            held, size, start = [], 0, row + 1
    if held:
        yield start, held


class Shard:
    """Words of one shard, numbered in the order they turn up."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_BREAK]  # the break is number 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        words = words_of([*texts, b""])
        self.parts.append(
            np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words))
        )
        self.size += sum(map(len, texts))

    def pair_keys(self, pairs: list[pa.Array]) -> np.ndarray:
        """The pairs whose words both turned up, as numbers."""
        find, found = self.numbers.get, []
        for some in pairs:
            words = pc.split_pattern(some, " ").flatten().to_pylist()
            both = np.array([find(w, -1) for w in words], dtype=np.int64).reshape(-1, 2)
            both = both[(both >= 0).all(axis=1)]
            found.append(both[:, 0] * len(self.numbers) + both[:, 1])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def mine(
        self, support: int, longest: int = MAX_WORDS, pairs: list[pa.Array] | None = None
    ) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """``(words, phrases, counts)``: every word, and every phrase of the given local support.

        With ``pairs``, only phrases of three words and more, whose pairs are all among them.
        """
        at = np.concatenate(self.parts)
        self.parts = []
        names = list(self.numbers)
        counts = np.bincount(at, minlength=len(names))
        if pairs is None:
            yield from _pieces(1, np.arange(1, len(names))[:, None], counts[1:], names)
        frequent = counts >= support
        frequent[0] = False
        # Number of the frequent phrase that starts at each place, or -1.
        here = np.where(frequent[at], at, -1).astype(np.int32)
        spelt = np.arange(len(names))[:, None]
        for length in range(2, longest + 1):
            ahead = here[1:]
            here = here[:-1]
            places = np.nonzero((here >= 0) & (ahead >= 0))[0]
            if not len(places):
                return
            # Two frequent phrases that overlap in all but their ends make the longer one.
            width = len(spelt)
            keys = here[places].astype(np.int64) * width + ahead[places]
            found, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            kept = counts >= support
            if pairs is not None and length == 2:
                kept &= np.isin(found, self.pair_keys(pairs))
            number = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
            nexts = np.full(len(here), -1, dtype=np.int32)
            nexts[places] = number[which]
            found = found[kept]
            spelt = np.hstack([spelt[found // width], spelt[found % width][:, -1:]])
            here = nexts
            del keys, which, places, ahead
            if pairs is None or length > 2:
                yield from _pieces(length, spelt, counts[kept], names)


def _pieces(
    length: int, spelt: np.ndarray, counts: np.ndarray, names: list[bytes]
) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    for at in range(0, len(spelt), EMIT_ROWS):
        rows = spelt[at : at + EMIT_ROWS].tolist()
        yield length, [b" ".join([names[i] for i in row]) for row in rows], counts[at : at + EMIT_ROWS]


def deal(docs: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``(lang, all_bytes, text, shard)`` of every text, and the number of shards."""
    sizes = docs.groupBy("lang").agg(F.sum("size").alias("all_bytes")).where("all_bytes > 0")
    wanted = F.greatest(
        F.ceil(F.col("all_bytes") / shard_bytes),
        F.least(F.lit(SPREAD_SHARDS), F.ceil(F.col("all_bytes") / LEAST_SHARD_BYTES)),
    )
    # One row per language; numbered one after the other.
    sizes = sizes.withColumn("shards", wanted.cast("long"))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialise(
        sizes.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0))), "phrase-shards"
    )
    total = int(sizes.agg(F.sum("shards").alias("n")).first()["n"] or 0)
    dealt = lookup_join(docs.where("size > 0"), sizes, ["lang"], spread_by=F.col("doc_id"))
    # Equal rows go to one shard; the worker cuts it where they are too many.
    number = F.col("first") + F.pmod(F.xxhash64("doc_id", "text"), F.col("shards"))
    return dealt.select("lang", "all_bytes", "text", number.cast("int").alias("shard")), max(1, total)


def mine_shards(
    dealt: DataFrame,
    shards: int,
    support: int,
    shard_bytes: int,
    longest: int = MAX_WORDS,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """``(lang, shard, phrase, words, count, hidden)`` from every shard: all words, and what is frequent there.

    ``count`` is the count in the shard, so sums over shards are exact for single words only.
    What a shard does not report occurs there ``hidden`` times at most; a row of no words has
    that number for every shard. With ``pairs`` ``(lang, shard, phrase)``, longer phrases of
    these pairs alone.
    """
    schema = "lang string, shard int, phrase binary, words int, count long, hidden long"
    only_longer = pairs is not None
    rows = dealt.select("lang", "all_bytes", "text", "shard", F.lit(False).alias("pair"))
    if pairs is not None:
        none = F.lit(0).cast("long").alias("all_bytes")
        known = pairs.select("lang", none, F.col("phrase").alias("text"), "shard", F.lit(True).alias("pair"))
        rows = rows.unionByName(known)
    rows = rows.repartitionById(shards, F.col("shard"))
    if pairs is not None:
        # A shard's pairs come in front of its texts.
        rows = rows.sortWithinPartitions(F.desc("pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lang, whole, number = Shard(), None, 0, 0
        allowed: dict[str, list[pa.Array]] = {}

        def results() -> Iterator[pa.RecordBatch]:
            least = max(1, -(-support * shard.size // whole))
            own = allowed.get(lang, []) if only_longer else None
            mined = shard.mine(least, longest, own)
            for length, phrases, counts in chain([(0, [b""], np.array([least - 1]))], mined):
                n = len(phrases)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()),
                        pa.array(np.full(n, number, dtype=np.int32)),
                        pa.array(phrases, pa.binary()),
                        pa.array(np.full(n, length, dtype=np.int32)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(np.full(n, least - 1, dtype=np.int64)),
                    ],
                    ["lang", "shard", "phrase", "words", "count", "hidden"],
                )

        for batch in batches:
            flags = batch.column(4)
            if only_longer and pc.any(flags).as_py():
                own = batch.filter(flags)
                for name in pc.unique(own.column(0)).to_pylist():
                    some = own.filter(pc.equal(own.column(0), name)).column(2)
                    allowed.setdefault(name, []).append(some)
                batch = batch.filter(pc.invert(flags))
            langs, sizes_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            numbers = batch.column(3).to_pylist()
            for start, texts in steps(batch, 2):
                # A partition holds one language; shards of several would be told apart here.
                cuts = [i for i in range(1, len(texts)) if langs[start + i] != langs[start + i - 1]]
                for low, high in zip([0, *cuts], [*cuts, len(texts)]):
                    if lang is not None and (
                        langs[start + low] != lang or shard.size >= 1.5 * shard_bytes
                    ):
                        yield from results()
                        shard = Shard()
                    at = start + low
                    lang, whole, number = langs[at], sizes_[at], numbers[at]
                    shard.add(texts[low:high])
        if lang is not None:
            yield from results()

    return rows.mapInArrow(run, schema)


def possible(mined: DataFrame, support: int) -> DataFrame:
    """``(lang, phrase, words, a, open)`` of mined phrases that may have the support in all shards.

    ``a`` is what shards report, ``open`` what the others may hide; with none open, ``a`` is exact.
    """
    every = mined.where("words = 0").groupBy("lang").agg(F.sum("count").alias("hides"))
    sums = mined.where("words > 1").groupBy("lang", "phrase", "words").agg(
        F.sum("count").alias("a"), F.sum("hidden").alias("told")
    )
    # One row per language.
    sums = lookup_join(sums, every, ["lang"], spread_by=F.col("phrase"))
    sums = sums.withColumn("open", F.col("hides") - F.col("told")).where(F.col("a") + F.col("open") >= support)
    return sums.select("lang", "phrase", "words", "a", "open")


class Trie:
    """Candidates of one language: sorted keys per length, each the shorter phrase and a word.

    What only begins candidates has the id -1.
    """

    def __init__(self, phrases: pa.Array, ids: np.ndarray):
        split = pc.split_pattern(phrases, " ")
        flat = split.flatten().dictionary_encode()
        lengths = split.value_lengths().to_numpy(False)
        starts = split.offsets.to_numpy(False)[:-1]
        numbers = flat.indices.to_numpy(False).astype(np.int64)
        self.words = flat.dictionary.to_pylist()
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        width = len(self.words)
        node = numbers[starts]
        for length in range(2, lengths.max() + 1):
            rows = np.nonzero(lengths >= length)[0]
            keys = node[rows] * width + numbers[starts[rows] + length - 1]
            keys, node[rows] = np.unique(keys, return_inverse=True)
            own = np.full(len(keys), -1, dtype=np.int64)
            ends = rows[lengths[rows] == length]
            own[node[ends]] = ids[ends]
            self.keys.append(keys)
            self.ids.append(own)

    def numbering(self) -> dict[bytes, int]:
        return _Numbers(zip(self.words, range(len(self.words))))

    def count(self, at: np.ndarray, into: list[np.ndarray]) -> None:
        """Add the occurrences among the word numbers ``at`` (-1: not a candidate's word)."""
        width = len(self.words)
        node, places = at, np.arange(len(at))
        for keys, counts, length in zip(self.keys, into, range(1, len(self.keys) + 1)):
            inside = places + length < len(at)
            node, places = node[inside], places[inside]
            last = at[places + length]
            go = (node >= 0) & (last >= 0)
            places, wanted = places[go], node[go] * width + last[go]
            spot = np.searchsorted(keys, wanted)
            spot[spot == len(keys)] = 0
            hit = keys[spot] == wanted
            node, places = spot[hit], places[hit]
            counts += np.bincount(node, minlength=len(keys))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def count_phrases(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(cid, a)``: occurrences of every candidate ``(cid, lang, phrase)`` in all texts.

    ``docs`` is read as it is stored: dealing it out would write all texts for every pass.
    """
    spark = docs.sparkSession
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], "cid long, a long")
    batches = max(1, -(-n // BATCH_PHRASES))
    pair = F.substring_index(F.col("phrase").cast("string"), " ", 2)
    dealt = candidates.withColumn("batch", F.pmod(F.xxhash64("lang", pair), F.lit(batches)))
    path = scratch_path(spark, "phrase-counts")
    for number in range(batches):
        held = dealt.where(F.col("batch") == number).select("cid", "lang", "phrase").toArrow()
        tries = {}
        for lang in pc.unique(held["lang"]).to_pylist():
            own = held.filter(pc.equal(held["lang"], lang)).combine_chunks()
            phrases = own["phrase"].combine_chunks()
            tries[lang] = Trie(phrases, own["cid"].to_numpy())
        shared = spark.sparkContext.broadcast(tries)
        counted = docs.select("lang", "text").mapInArrow(_counter(shared), "cid long, a long")
        counted.groupBy("cid").agg(F.sum("a").alias("a")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = shared.value
        numbers = {lang: trie.numbering() for lang, trie in tries.items()}
        counts = {
            lang: [np.zeros(len(k), dtype=np.int64) for k in trie.keys] for lang, trie in tries.items()
        }
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in steps(batch, 1):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[start:], texts):
                    by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    if lang in tries:
                        words = words_of(own)
                        at = np.fromiter(
                            map(numbers[lang].__getitem__, words), dtype=np.int64, count=len(words)
                        )
                        tries[lang].count(at, counts[lang])
        for lang, trie in tries.items():
            for ids, found in zip(trie.ids, counts[lang]):
                seen = np.nonzero((found > 0) & (ids >= 0))[0]
                if len(seen):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[seen]), pa.array(found[seen])], ["cid", "a"]
                    )

    return run


def phrase_counts(
    docs: DataFrame, support: int = SUPPORT, shard_bytes: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, a)`` of frequent phrases and words, and ``(lang, n)``, both exact."""
    texts = prepared(docs)
    dealt, shards = deal(texts, shard_bytes)
    mined = materialise(mine_shards(dealt, shards, support, shard_bytes, longest=2), "phrases-mined")
    words = materialise(
        mined.where("words = 1").groupBy("lang", "phrase").agg(F.sum("count").alias("a")),
        "phrase-words",
    )
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    pairs = materialise(possible(mined, support), "phrase-pairs")
    own = mined.where("words = 2").join(pairs.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    longer = materialise(
        mine_shards(dealt, shards, support, shard_bytes, pairs=own), "phrases-longer"
    )
    # Stored with its numbers, so that both passes below see the same ones.
    candidates = materialise(
        pairs.unionByName(possible(longer, support)).withColumn("cid", F.monotonically_increasing_id()),
        "phrase-candidates",
    )
    unsure = candidates.where("open > 0").drop("a")
    counted = count_phrases(spread(texts, "doc_id"), unsure).where(F.col("a") >= support)
    longer = candidates.where("open = 0").select("lang", "phrase", "words", "a").unionByName(
        unsure.join(counted, "cid").select("lang", "phrase", "words", "a")
    )
    single = words.where(F.col("a") >= support).select(
        "lang", "phrase", F.lit(1).alias("words"), "a"
    )
    both = single.unionByName(longer).withColumn("phrase", F.col("phrase").cast("string"))
    return materialise(both, "phrase-frequent"), totals


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 a n / (l r))`` in exact decimals; the quotient fits 64 bits, as ``a <= l, r``."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    product = F.lit(1000).cast("decimal(4,0)") * wide(a, 15) * wide(n, 16)
    return F.call_function("div", product, wide(left, 15) * wide(right, 15))


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The ``top`` phrases of every language by their weakest cut, without parts of equal longer ones."""
    frequent, totals = phrase_counts(docs, support, shard_bytes)
    phrases = frequent.where("words > 1")
    spelt = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.select("lang", "phrase", "words", "a", cut.alias("k"))
    part = lambda low, n: F.array_join(F.slice(spelt, low, n), " ")
    cuts = cuts.withColumn("left", part(F.lit(1), F.col("k"))).withColumn(
        "right", part(F.col("k") + 1, F.col("words") - F.col("k"))
    )
    known = lambda name, count: frequent.select(
        "lang", F.col("phrase").alias(name), F.col("a").alias(count)
    )
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    # One row per language.
    cuts = lookup_join(cuts, totals, ["lang"], spread_by=F.col("phrase"))
    score = _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("weakest")
    )
    scored = scored.select("lang", "phrase", "weakest.*")
    # A phrase as frequent as a longer one is as frequent as one that is longer by a word.
    inner = phrases.where("words > 2").select(
        "lang",
        F.explode(
            F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))
        ).alias("phrase"),
        "a",
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < 100 * F.col("a"), F.lit(True))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task sees a whole one.
    slot = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = Window.partitionBy("lang", "slot").orderBy(*order)
    left = left.withColumn("slot", slot).withColumn("_n", F.row_number().over(some))
    left = left.where(F.col("_n") <= top)
    ranked = left.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return ranked.where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def check_sql() -> str:
    """The same rows from DuckDB."""
    grams = "\n        UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[i:i + {n - 1}], ' ') AS phrase, {n} AS words "
        f"FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM pieces WHERE len(ws) >= {n})"
        for n in range(1, MAX_WORDS + 1)
    )
    return f"""
    WITH pieces AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
        FROM (
            SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        )
    ), grams AS (
        {grams}
    ), f AS (
        SELECT lang, phrase, words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}
    ), totals AS (
        SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
    ), cuts AS (
        SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, words)) AS k
        FROM f WHERE words > 1
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n,
               ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM cuts c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
        JOIN totals t ON t.lang = c.lang
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
    ), longer AS (
        SELECT lang, phrase, max(a) AS most FROM (
            SELECT lang, a, unnest([array_to_string(ws[1:words - 1], ' '), array_to_string(ws[2:], ' ')]) AS phrase
            FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE words > 2)
        ) GROUP BY ALL
    )
    SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
    FROM scored LEFT JOIN longer USING (lang, phrase)
    WHERE coalesce(100 * most < 100 * a, true)
    WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY row_number() OVER w <= {TOP}
    """
