"""Token ids in directly addressable codes, written and read as a file format.

A segment holds the ids of consecutive documents. Every id is split into chunks of eight
bits. The first level has one chunk per id and a bitmap that says which ids go on; the
next level has a chunk for each of those, and so on. A rank directory over each bitmap
gives the number of set bits before any position, so that one id (``DacSegment.token``) or the ids
of one document (``DacSegment.tokens``) are found by one look at each of their levels,
without decoding anything else. Documents are read back in this way.

Segment layout, little endian: magic ``DAC1``, levels (u8), three zero bytes, documents
(u64), tokens (u64), first token of the segment's bucket part (u64); the document
directory: ids (i64 each, with a null bitmap) and token counts (u64 each); then per level
the number of chunks (u64), the chunks, the bitmap (whole 64-bit words) and the directory
(one u64 per 512 bits). A segment never splits a document. Segments are stored as rows of
a Parquet container, so that Spark's own commit protocol guards them on any store.

Order: documents go to buckets of ascending id ranges, each bucket is sorted and cut into
segments; a token's global number is its number in the bucket plus the tokens of all
buckets before. A null text is empty; every document ends with the end id. Documents
without an id come first. Repeated ids stand next to each other, in the order of their
texts. An empty table gives no segment. Columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.prefix import range_bounds, range_bucket
from tokenloom.session import scratch_path

MAGIC = b"DAC1"
END_ID = 1
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
BUCKET_ROWS = 4096
CACHED_WORDS = 300_000
#: Without the apostrophe, which can belong to a contraction.
PUNCTUATION = "".join(c for c in string.punctuation if c != "'")

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Bits as bytes, filled up to whole 64-bit words; bit i is bit ``i % 8`` of byte ``i // 8``."""
    packed = np.packbits(flags, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)])


def _directory(bitmap: np.ndarray) -> np.ndarray:
    """Set bits before every 512th bit."""
    counts = _ONES[bitmap]
    step = RANK_BITS // 8
    blocks = np.add.reduceat(counts, np.arange(0, len(counts), step), dtype=np.uint64) if len(counts) else counts.astype(np.uint64)
    return np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u8") if len(blocks) else blocks


def encode_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, start: int = 0) -> bytes:
    """One segment from its documents, their token counts and all their ids."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest >= (1 << CHUNK_BITS)
        bitmap = _bitmap(more)
        levels.append((rest.astype(np.uint8), bitmap, _directory(bitmap)))
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    head = [
        MAGIC, bytes([len(levels), 0, 0, 0]),
        np.array([len(doc_ids), len(ids), start], dtype="<u8").tobytes(),
        _bitmap(known).tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.asarray(counts, dtype="<u8").tobytes(),
    ]
    for chunks, bitmap, directory in levels:
        head += [np.array([len(chunks)], dtype="<u8").tobytes(), chunks.tobytes()]
        head += [bitmap.tobytes(), directory.tobytes()]
    return b"".join(head)


class DacSegment:
    """Random access to a segment's bytes; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        at = 8
        self.n_docs, self.n_tokens, self.start = (
            int(v) for v in np.frombuffer(data, "<u8", 3, at)
        )
        at += 24

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype, n, at)
            at += found.nbytes
            return found

        words = lambda bits: -(-bits // 64) * 8
        known = np.unpackbits(take("u1", words(self.n_docs)), bitorder="little")[: self.n_docs]
        ids = take("<i8", self.n_docs).tolist()
        self.doc_ids = [d if k else None for d, k in zip(ids, known.tolist())]
        self.counts = take("<u8", self.n_docs).astype(np.int64)
        self.levels = []
        for _ in range(data[4]):
            n = int(take("<u8", 1)[0])
            chunks, bitmap = take("u1", n), take("u1", words(n))
            self.levels.append((chunks, bitmap, take("<u8", -(-len(bitmap) * 8 // RANK_BITS))))

    def token(self, i: int) -> int:
        """The ``i``-th id of the segment."""
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            shift += CHUNK_BITS
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            block = i // RANK_BITS
            before = int(directory[block]) + int(_ONES[bitmap[block * RANK_BITS // 8 : byte]].sum())
            i = before + int(_ONES[bitmap[byte] & ((1 << bit) - 1)])
        return value

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (left out) of the segment, without decoding any other.

        Neighbours stay neighbours on every level, so that one look into a level's directory
        finds where the run goes on in the next.
        """
        runs = []
        for chunks, bitmap, directory in self.levels:
            if first >= last:
                break
            byte, bit = divmod(first, 8)
            bits = np.unpackbits(bitmap[byte : -(-last // 8)], bitorder="little")
            more = bits[bit : bit + last - first].view(bool)
            runs.append((chunks[first:last].astype(np.uint32), more))
            block = first // RANK_BITS
            step = RANK_BITS // 8
            before = int(directory[block]) + int(_ONES[bitmap[block * step : byte]].sum())
            first = before + int(bits[:bit].sum())
            last = first + int(more.sum())
        rest = np.zeros(0, dtype=np.uint32)
        for whole, more in reversed(runs):
            whole[more] |= rest << CHUNK_BITS
            rest = whole
        return rest


Tokenise = Callable[[list[str]], list[bytes]]


class WordTokenizer:
    """Whole texts through a ``tokenizers`` file, word by word.

    For a tokenizer that lower-cases, cuts punctuation off letters and never joins anything
    across white space: a text's ids are those of its space-separated pieces in order, and a
    piece's are those of its word and of the ASCII punctuation behind it. Pieces are cut at
    plain spaces and line ends alone. New words of letters are tokenised many at a time and
    told apart by the tokens that end a word. A piece that names a special token goes to the
    library as it is. The table of known pieces is bounded; what was
    used since it last filled up stays in it.
    """

    def __init__(self, path: str, end_id: int = END_ID, cached: int = CACHED_WORDS):
        # Spark has a worker for every core; threads of its own would only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._special = [token.content.lower() for token in added]
        size = self._tokenizer.get_vocab_size()
        names = (self._tokenizer.id_to_token(i) or "" for i in range(size))
        self._ends_word = np.array([name.endswith("</w>") for name in names])
        self._end = np.array([end_id], dtype="<u4").tobytes()
        self._cached = cached
        self._known: dict[str, bytes] = {}
        self._earlier: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        rest = list(set(words).difference(letters))
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self._ends_word[ids]) + 1
            if len(ends) == len(group):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self._known.update(zip(group, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                rest += group
        for word, ids in zip(rest, self._encode(rest)):
            self._known[word] = ids.tobytes()

    def _names_special(self, text: str) -> bool:
        lower = text.lower()
        return any(name in lower for name in self._special)

    def _pieces(self, text: str) -> list[str]:
        """Pieces between spaces and line ends; in lower case where that changes no id."""
        if text.isascii() and not self._names_special(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, with the end id, as little-endian 32-bit integers."""
        if len(self._known) > self._cached:
            self._known, self._earlier = {}, self._known
        pieces = [self._pieces(t) for t in texts]
        known, earlier = self._known, self._earlier
        new = set().union(*pieces).difference(known)
        # A set's own intersection would go through the whole earlier table.
        again = {piece for piece in new if piece in earlier}
        known.update((piece, earlier[piece]) for piece in again)
        marked = any(map(self._names_special, texts))
        unknown, cut = set(), []
        for piece in new - again:
            # A word and the ASCII punctuation behind it, if they can be told apart.
            word = piece.rstrip(PUNCTUATION)
            if len(word) == len(piece) or not word[-1:].isalpha():
                unknown.add(piece)
            elif marked and self._names_special(piece):
                unknown.add(piece)
            else:
                cut.append((piece, word, piece[len(word) :]))
                unknown.update(cut[-1][1:])
        self._learn(list(unknown.difference(known)))
        for piece, word, tail in cut:
            known[piece] = known[word] + known[tail]
        find = known.__getitem__
        return [b"".join(map(find, words)) + self._end for words in pieces]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_segments(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    segment_tokens: int = SEGMENT_TOKENS,
    bucket_rows: int = BUCKET_ROWS,
) -> None:
    """Encode all documents in ascending id order and store their segments under ``path``.

    The texts are shuffled once, by ranges of the id; tokens are made where they are written.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = max(1, -(-rows.select("doc_id").count() // bucket_rows))
    bounds = range_bounds(rows.select("doc_id"), "doc_id", buckets)
    ordered = (
        rows.withColumn("bucket", range_bucket(F.col("doc_id"), bounds).cast("int"))
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = word_tokenizer(tokenizer_path)
        ids: list[int | None] = []
        parts: list[bytes] = []
        state = {"bucket": None, "seq": 0, "start": 0, "size": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            counts = np.array([len(p) // 4 for p in parts])
            blob = encode_segment(
                ids, counts, np.frombuffer(b"".join(parts), "<u4"), state["start"]
            )
            row = [[state["bucket"]], [state["seq"]], [int(counts.sum())], [blob]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], ["bucket", "seq", "n_tokens", "segment"]
            )
            state["seq"] += 1
            state["start"] += int(counts.sum())
            state["size"] = 0
            ids.clear()
            parts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = ["" if t is None else t for t in piece.column("text").to_pylist()]
                encoded = tokenise(texts)
                cells = zip(piece.column("doc_id").to_pylist(), piece.column("bucket").to_pylist())
                for (doc_id, bucket), data in zip(cells, encoded):
                    if bucket != state["bucket"] or state["size"] + len(data) // 4 > segment_tokens:
                        yield from flush()
                    if bucket != state["bucket"]:
                        state.update(bucket=bucket, seq=0, start=0)
                    ids.append(doc_id)
                    parts.append(data)
                    state["size"] += len(data) // 4
        yield from flush()

    written = ordered.mapInArrow(run, "bucket int, seq int, n_tokens long, segment binary")
    # The blobs are dense already.
    written.write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document from stored segments."""
    segments = spark.read.schema("bucket int, seq int, n_tokens long, segment binary").parquet(path)
    sums = segments.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()
    before, total = {}, 0
    # One number for every bucket of documents.
    for row in sorted(sums, key=lambda r: r["bucket"]):
        before[row["bucket"]] = total
        total += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment = DacSegment(data.as_py())
                ends = np.cumsum(segment.counts)
                starts = ends - segment.counts
                pieces = [
                    segment.tokens(a, b).astype("<u4").tobytes()
                    for a, b in zip(starts.tolist(), ends.tolist())
                ]
                columns = [
                    pa.array(segment.doc_ids, pa.int64()),
                    pa.array(starts + segment.start + before[bucket], pa.int64()),
                    pa.array(segment.counts, pa.int64()),
                    pa.array(list(map(zlib.crc32, pieces)), pa.int64()),
                    pa.array(pieces, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                )

    return segments.select("bucket", "segment").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the documents' segments to the shared scratch folder and read them back."""
    path = scratch_path(docs.sparkSession, "dac")
    write_segments(docs, path, tokenizer_path)
    return read_documents(docs.sparkSession, path)
