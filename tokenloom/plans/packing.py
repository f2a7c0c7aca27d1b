"""Queries: corpus packing and window serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import digest
from tokenloom.functions.permutation import ROUNDS
from tokenloom.functions.rates import accumulation_steps
from tokenloom.operators import pack, windows
from tokenloom.operators.quality import id_range, shards_before_gap
from tokenloom.operators.tokenizers import ByteTokenizer, with_leading_delimiter
from tokenloom.plans import sqltext as q
from tokenloom.plans.catalog import documents, query
from tokenloom.session import materialise, scratch_path, spread
from tokenloom.sources.corpus import (
    read_corpus,
    read_text_corpus,
    with_file_ordinal,
    write_text_corpus,
)
from tokenloom.sources.shards import (
    fragments_at,
    read_token_shards,
    shard_faults,
    write_manifest,
    write_token_shards,
)

BYTES = ByteTokenizer()
# Small enough that the test tables fill many shards and windows.
SHARD, WINDOW, WORLD, BATCH = 100_000, 64, 2, 4


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_corpus(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return spread(docs.select("doc_id", "text", "source"), "doc_id")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.place_documents(_documents(spark, sf_dir).select("doc_id", "text"), BYTES)


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.shard_fragments(_placed(spark, sf_dir), BYTES, SHARD)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window index from shard lengths alone; no token is made for it."""
    summary = pack.shard_summary(pack.shard_pieces(_placed(spark, sf_dir), SHARD))
    return windows.window_index(summary.select("split", "shard_id", "n_tokens"), WINDOW)


@query(
    f"""WITH {q.placed(SHARD)}
SELECT {q.SPLIT} AS split, shard_id, sum(hi - lo)::BIGINT AS n_tokens, count(*) AS n_pieces,
       sum(CASE WHEN s = lo THEN 1 ELSE 0 END)::BIGINT AS n_docs_started
FROM pieces GROUP BY 1, 2"""
)
def corpus_pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.shard_summary(pack.shard_pieces(_placed(spark, sf_dir), SHARD))


FRAGMENTS_SQL = f"""WITH {q.placed(SHARD)},
t AS (SELECT doc_id, [256] || {q.byte_list('text')} AS toks FROM documents)
SELECT {q.SPLIT} AS split, shard_id, (lo - shard_id * {SHARD})::BIGINT AS shard_pos, doc_id,
       (hi - lo)::BIGINT AS n_piece,
       {q.md5_list('toks[lo - s + 1 : hi - s]')} AS tokens_md5
FROM pieces JOIN t USING (doc_id)"""


@query(FRAGMENTS_SQL)
def corpus_pack_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragment_view(_fragments(spark, sf_dir))


def _fragment_view(fragments: DataFrame) -> DataFrame:
    return fragments.select(
        "split",
        "shard_id",
        "shard_pos",
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_piece"),
        digest(F.col("tokens")).alias("tokens_md5"),
    )


@query(
    f"""WITH {q.placed(SHARD)}
SELECT {q.SPLIT} AS split, shard_id, count(*) AS n_pieces, sum(hi - lo)::BIGINT AS n_tokens,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM pieces GROUP BY 1, 2"""
)
def token_shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write shards, then read both splits back."""
    path = scratch_path(spark, "token-shards")
    write_token_shards(_fragments(spark, sf_dir), path)
    both = read_token_shards(spark, path, "val").unionByName(
        read_token_shards(spark, path, "train")
    )
    return both.groupBy("split", "shard_id").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
    )


@query(
    """SELECT source, CASE WHEN grouping(source) = 1 THEN 1 ELSE 0 END AS is_total,
       count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens,
       (sum(strlen(text) + 1)::BIGINT // 4096) AS steps_per_epoch
FROM documents GROUP BY ROLLUP (source)"""
)
def corpus_size_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.corpus_size(_documents(spark, sf_dir), BYTES, batch_tokens=4096)


@query(
    f"""WITH {q.placed(SHARD)},
c AS (SELECT *, floor(sum(n) OVER () * 0.9::DOUBLE)::BIGINT AS cut FROM placed),
parts AS (
  SELECT 'train' AS split, doc_id, s AS split_pos, 0 AS doc_pos, least(s + n, cut) - s AS n_piece FROM c
  UNION ALL
  SELECT 'val', doc_id, greatest(s - cut, 0), greatest(cut - s, 0), s + n - greatest(s, cut) FROM c)
SELECT split, doc_id, split_pos::BIGINT AS split_pos, doc_pos::BIGINT AS doc_pos,
       n_piece::BIGINT AS n_piece FROM parts WHERE n_piece > 0"""
)
def corpus_contiguous_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.contiguous_split(_placed(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT [256] || {q.byte_list('text')} AS toks FROM documents)
SELECT min(list_min(toks))::BIGINT AS min_id, max(list_max(toks))::BIGINT AS max_id,
       count(*) FILTER (list_max(toks) >= 65536 OR list_min(toks) < 0) AS n_bad_rows FROM t"""
)
def token_id_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(
        with_leading_delimiter(BYTES, F.col("text")).alias("tokens")
    )
    return id_range(rows).select(
        F.col("min_id").cast("bigint").alias("min_id"),
        F.col("max_id").cast("bigint").alias("max_id"),
        "n_bad_rows",
    )


@query(
    """SELECT doc_id, (file_row_number)::BIGINT AS ord FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS file_row_number FROM documents)"""
)
def corpus_file_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals from file positions; the test table lies in ``doc_id`` order."""
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    return with_file_ordinal(spark, path, "doc_id BIGINT")


@query(
    f"WITH {q.placed(SHARD)},{q.windows(SHARD, WINDOW)} SELECT split, shard_id, win, start FROM idx"
)
def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(
    f"""WITH {q.placed(SHARD)},{q.stream_tokens(SHARD)},{q.window_lists(SHARD, WINDOW)}
SELECT {q.SPLIT} AS split, shard_id, win, {q.md5_list(f'toks[1:{WINDOW}]')} AS x_md5,
       {q.md5_list(f'toks[2:{WINDOW + 1}]')} AS y_md5 FROM wins"""
)
def window_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = materialise(_fragments(spark, sf_dir), "fragments")
    rows = windows.shifted_pair(windows.window_tokens(fragments, WINDOW))
    return rows.select(
        "split",
        "shard_id",
        "win",
        digest(F.col("x")).alias("x_md5"),
        digest(F.col("y")).alias("y_md5"),
    )


def _batch_sql(split: str, order: str, epoch: int) -> str:
    return f"""
SELECT {epoch}::BIGINT AS epoch, split, shard_id, start, pos % {WORLD} AS rank,
       (pos // {WORLD}) // {BATCH} AS batch_id, (pos // {WORLD}) % {BATCH} AS slot
FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS total
      FROM idx WHERE split = '{split}')
WHERE (pos // {WORLD}) // {BATCH} < ((total - pos % {WORLD} + {WORLD - 1}) // {WORLD}) // {BATCH}"""


@query(
    f"""WITH {q.placed(SHARD)},{q.windows(SHARD, WINDOW)}
{_batch_sql('train', "md5('1337-0-' || shard_id || '-' || win)", 0)}
UNION ALL {_batch_sql('train', "md5('1337-1-' || shard_id || '-' || win)", 1)}
UNION ALL {_batch_sql('val', 'shard_id, win', 0)}"""
)
def window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shuffled training epochs and one ordered validation pass."""
    index = materialise(_index(spark, sf_dir), "windows")

    def served(split: str, epoch: int) -> DataFrame:
        order = windows.served_order(index, ("shard_id", "win"), split, epoch=epoch)
        order = windows.with_total(order, index.where(F.col("split") == split))
        return windows.batches(order, BATCH, WORLD, "n_rows").withColumn(
            "epoch", F.lit(epoch).cast("bigint")
        )

    rows = served("train", 0).unionByName(served("train", 1)).unionByName(served("val", 0))
    return rows.select(
        "epoch",
        "split",
        "shard_id",
        "start",
        F.col("rank").cast("bigint").alias("rank"),
        "batch_id",
        F.col("slot").cast("bigint").alias("slot"),
    )


@query(
    f"""WITH {q.placed(SHARD)},{q.windows(SHARD, WINDOW)},{q.stream_tokens(SHARD)},{q.window_lists(SHARD, WINDOW)},
b AS ({_batch_sql('train', "md5('1338-0-' || shard_id || '-' || win)", 0)})
SELECT rank, batch_id, slot, {q.md5_list(f'toks[1:{WINDOW}]')} AS x_md5,
       {q.md5_list(f'toks[2:{WINDOW + 1}]')} AS y_md5
FROM b JOIN wins ON wins.shard_id = b.shard_id AND wins.win * {WINDOW} = b.start"""
)
def window_batches_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the first training epoch after a reset, with their inputs and targets."""
    fragments = materialise(_fragments(spark, sf_dir), "fragments")
    lengths = windows.shard_lengths(fragments)
    index = materialise(windows.window_index(lengths, WINDOW), "windows")
    seed = windows.next_seed(fv.SERVE_SEED, "train")
    order = windows.served_order(index, ("shard_id", "win"), "train", seed=seed)
    order = windows.with_total(order, index.where(F.col("split") == "train"))
    served = windows.batches(order, BATCH, WORLD, "n_rows")
    rows = windows.window_tokens(fragments.where(F.col("split") == "train"), WINDOW)
    pairs = windows.shifted_pair(
        rows.join(served.drop("start", "perm_pos", "n_rows"), ["split", "shard_id", "win"])
    )
    return pairs.select(
        F.col("rank").cast("bigint").alias("rank"),
        "batch_id",
        F.col("slot").cast("bigint").alias("slot"),
        digest(F.col("x")).alias("x_md5"),
        digest(F.col("y")).alias("y_md5"),
    )


@query(
    f"""WITH {q.placed(SHARD)},
kept AS (SELECT {q.SPLIT} AS split, shard_id FROM pieces GROUP BY 1, 2 HAVING count(*) > 35),
firsts AS (SELECT split, min(shard_id) AS f FROM kept GROUP BY 1),
numbered AS (SELECT split, shard_id - f AS shard_id FROM kept JOIN firsts USING (split)),
runs AS (SELECT split, shard_id, row_number() OVER (PARTITION BY split ORDER BY shard_id) - 1 AS k FROM numbered)
SELECT split, count(*) AS n_shards, max(shard_id)::BIGINT AS last_shard,
       count(*) FILTER (k = shard_id) AS n_before_gap FROM runs GROUP BY 1"""
)
def shard_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of few pieces are left out on purpose; numbers restart at 0 in each split."""
    summary = pack.shard_summary(pack.shard_pieces(_placed(spark, sf_dir), SHARD))
    kept = materialise(
        summary.where(F.col("n_pieces") > 35).select("split", "shard_id"), "kept-shards"
    )
    firsts = kept.groupBy("split").agg(F.min("shard_id").alias("first"))
    numbered = kept.join(firsts, "split").select(
        "split", (F.col("shard_id") - F.col("first")).alias("shard_id")
    )
    whole = numbered.groupBy("split").agg(
        F.count_distinct("shard_id").alias("n_shards"), F.max("shard_id").alias("last_shard")
    )
    before = (
        shards_before_gap(numbered).groupBy("split").agg(F.count(F.lit(1)).alias("n_before_gap"))
    )
    return whole.join(before, "split")


SCHEDULE_SQL = f"""
n AS (SELECT split, count(*) AS n_rows FROM idx GROUP BY 1),
r AS (SELECT split, n_rows, unnest(range({WORLD})) AS rank FROM n),
sched AS (
  SELECT split, n_rows, rank, (n_rows - rank + {WORLD - 1}) // {WORLD} AS rank_rows FROM r)"""


@query(
    f"""WITH {q.placed(SHARD)},{q.windows(SHARD, WINDOW)},{SCHEDULE_SQL}
SELECT split, n_rows, rank, rank_rows, rank_rows // {BATCH} AS rank_batches,
       rank_rows // {BATCH} // 4 AS steps_per_epoch, rank_rows // {BATCH} // 4 * 7 AS max_steps
FROM sched"""
)
def schedule_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    accumulation = accumulation_steps(2048, BATCH, WINDOW, WORLD)
    plan = windows.schedule(
        _index(spark, sf_dir), batch_rows=BATCH, world=WORLD, accumulation=accumulation, epochs=7
    )
    return plan.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH {q.placed(SHARD)},{q.windows(SHARD, WINDOW)},{SCHEDULE_SQL}
SELECT split, rank, g, g // per AS epoch, g % per AS batch_id FROM (
  SELECT split, rank, rank_rows // {BATCH} AS per,
         unnest(range(2 * (rank_rows // {BATCH}) + 3)) AS g FROM sched)"""
)
def window_wraparound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running batch numbers over two epochs and a little more."""
    plan = windows.schedule(
        _index(spark, sf_dir), batch_rows=BATCH, world=WORLD, accumulation=1, epochs=1
    ).where("rank_batches > 0")
    running = plan.select(
        "split",
        F.col("rank").cast("bigint").alias("rank"),
        "rank_batches",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rank_batches") * 2 + 2)).alias("g"),
    )
    epoch, batch = windows.epoch_of_batch(F.col("g"), F.col("rank_batches"))
    return running.select("split", "rank", "g", epoch.alias("epoch"), batch.alias("batch_id"))


# ---------------------------------------------------------------------------------------
# Shards by their manifest, and serving orders that are computed.

MARK = 4096


def _described(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Stored shards and their manifest."""
    path = scratch_path(spark, "token-shards")
    write_token_shards(_fragments(spark, sf_dir), path)
    return path, write_manifest(spark, path, MARK)


@query(
    f"""WITH {q.placed(SHARD)}
SELECT {q.SPLIT} AS split, shard_id, count(*) AS n_pieces, sum(hi - lo)::BIGINT AS n_tokens,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       count(DISTINCT (lo - shard_id * {SHARD}) // {MARK}) AS n_marks,
       (sum(hi - lo)::BIGINT - 1) // {WINDOW} AS n_windows
FROM pieces GROUP BY 1, 2"""
)
def token_shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of every shard; windows are counted from it."""
    _, manifest = _described(spark, sf_dir)
    n_windows = windows.window_index(manifest, WINDOW).groupBy("split", "shard_id").count()
    return manifest.join(n_windows, ["split", "shard_id"], "left").select(
        "split", "shard_id", "n_pieces", "n_tokens", "first_doc", "last_doc",
        F.size("marks").cast("bigint").alias("n_marks"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("n_windows"),
    )


@query(
    f"""WITH {q.placed(SHARD)},
k AS (SELECT shard_id, min({q.SPLIT}) AS split, sum(hi - lo)::BIGINT AS n, max(shard_id) OVER () AS last
      FROM pieces GROUP BY shard_id)
SELECT CASE WHEN shard_id % 5 <> 2 OR shard_id = last THEN split END AS split, shard_id,
       CASE WHEN shard_id % 5 = 2 AND shard_id < last THEN 'missing' WHEN shard_id % 5 = 3 THEN 'doubled'
            ELSE 'torn' END AS fault
FROM k WHERE (shard_id % 5 = 2 AND shard_id < last) OR shard_id % 5 = 3
   OR (shard_id % 5 = 4 AND n > 100)"""
)
def shard_manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some shards are taken out, doubled or cut short on purpose; all have to be found."""
    _, manifest = _described(spark, sf_dir)
    manifest = materialise(manifest, "manifest")
    last = manifest.agg(F.max("shard_id")).scalar()
    fifth = F.col("shard_id") % 5
    damaged = manifest.where((fifth != 2) | (F.col("shard_id") == last)).withColumn(
        "n_tokens",
        F.when((fifth == 4) & (F.col("n_tokens") > 100), F.col("n_tokens") - 100).otherwise(
            F.col("n_tokens")
        ),
    )
    damaged = damaged.unionByName(damaged.where(fifth == 3))
    return shard_faults(damaged, SHARD)


STEP = 997


@query(
    f"""WITH {q.placed(SHARD)}
SELECT shard_id, (p - shard_id * {SHARD})::BIGINT AS shard_pos, doc_id, (p - lo)::BIGINT AS doc_offset
FROM (SELECT *, unnest(range(((lo + {STEP - 1}) // {STEP}) * {STEP}, hi, {STEP})) AS p FROM pieces)"""
)
def shard_position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document holds each of some positions spread over the whole stream."""
    path, manifest = _described(spark, sf_dir)
    size = F.lit(SHARD).cast("bigint")
    begin = F.col("shard_id") * size
    first = F.call_function("div", begin + (STEP - 1), F.lit(STEP).cast("bigint")) * STEP
    asked = manifest.where(first < begin + F.col("n_tokens")).select(
        "shard_id",
        F.explode(
            F.transform(
                F.sequence(first, begin + F.col("n_tokens") - 1, F.lit(STEP).cast("bigint")),
                lambda p: p - F.col("shard_id") * size,
            )
        ).alias("shard_pos"),
    )
    return fragments_at(asked, manifest, read_token_shards(spark, path), MARK)


EPOCHS, ORDER_SEED = 3, 2024


def _hash_sql(number: int, digit: str) -> str:
    key = f"'{ORDER_SEED}-' || epoch || '-{number}-' || {digit}"
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def _rounds_sql() -> str:
    rows = "SELECT * EXCLUDE (y), y // wide AS l, y % wide AS r FROM walk WHERE steps = 0 OR y >= n_rows"
    for number in range(ROUNDS):
        if number % 2:
            moved = f"l, (r + {_hash_sql(number, 'l')} % wide) % wide AS r"
        else:
            moved = f"(l + {_hash_sql(number, 'r')} % high) % high AS l, r"
        rows = f"SELECT * EXCLUDE (l, r), {moved} FROM ({rows})"
    return f"""SELECT split, shard_id, win, row, n_rows, epoch, wide, high, steps + 1 AS steps,
       l * wide + r AS y FROM ({rows})"""


@query(
    f"""WITH RECURSIVE {q.placed(SHARD)},{q.windows(SHARD, WINDOW)},
numbered AS (
  SELECT split, shard_id, win, row_number() OVER (PARTITION BY split ORDER BY shard_id, win) - 1 AS row,
         count(*) OVER (PARTITION BY split) AS n_rows FROM idx),
walk AS (
  SELECT *, greatest((n_rows + wide - 1) // wide, 1) AS high, 0 AS steps, row AS y FROM (
    SELECT *, greatest(ceil(sqrt(n_rows::DOUBLE))::BIGINT, 1) AS wide
    FROM numbered, (SELECT unnest(range({EPOCHS})) AS epoch) WHERE split = 'train')
  UNION ALL {_rounds_sql()}),
served AS (SELECT *, y AS p FROM walk WHERE steps > 0 AND y < n_rows),
placed_rows AS (
  SELECT *, p % {WORLD} AS rank, (p // {WORLD}) // {BATCH} AS batch_id, (p // {WORLD}) % {BATCH} AS slot,
         ((n_rows - p % {WORLD} + {WORLD - 1}) // {WORLD}) // {BATCH} AS per FROM served)
SELECT epoch, rank, epoch * per + batch_id AS running_batch, slot, shard_id, win
FROM placed_rows WHERE batch_id < per"""
)
def served_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three training epochs, their batches numbered on through the wrap-around.

    The order comes from the manifest and the rows' own numbers; no index is sorted.
    """
    _, manifest = _described(spark, sf_dir)
    shards = windows.with_ordinal(
        manifest.where(F.col("split") == "train").select("split", "shard_id", "n_tokens"), WINDOW
    )
    n = F.call_function("div", F.col("n_tokens") - 1, F.lit(WINDOW).cast("bigint"))
    rows = shards.where(n > 0).select(
        "shard_id", F.col("split_rows").alias("n_rows"), "first_row",
        F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("win"),
    )
    rows = rows.withColumn("row", F.col("first_row") + F.col("win"))
    epochs = F.sequence(F.lit(0).cast("bigint"), F.lit(EPOCHS - 1).cast("bigint"))
    ordered = windows.computed_order(rows, seed=ORDER_SEED, epochs=epochs)
    served = windows.batches(ordered, BATCH, WORLD, "n_rows")
    return served.select(
        "epoch",
        F.col("rank").cast("bigint").alias("rank"),
        windows.running_batch(
            F.col("epoch"), F.col("batch_id"), F.col("rank"), F.col("n_rows"), BATCH, WORLD
        ).alias("running_batch"),
        F.col("slot").cast("bigint").alias("slot"),
        "shard_id",
        "win",
    )


@query(
    f"""WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text || chr(10) AS text FROM documents),
sized AS (
  SELECT doc_id, text, (strlen(text) + 1)::BIGINT AS n,
         (sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1)::BIGINT AS s,
         (sum(strlen(text) + 1) OVER ())::BIGINT AS total FROM docs),
cut AS (SELECT *, floor(total * 0.9::DOUBLE)::BIGINT AS c, [256] || {q.byte_list('text')} AS toks FROM sized),
parts AS (
  SELECT 'train' AS split, doc_id, s AS pos, toks[1:least(s + n, c) - s] AS t FROM cut WHERE s < c
  UNION ALL
  SELECT 'val', doc_id, greatest(s, c) - c, toks[greatest(s, c) - s + 1:n] FROM cut WHERE s + n > c)
SELECT split, doc_id::BIGINT AS doc_id, pos::BIGINT AS shard_pos, len(t)::BIGINT AS n_piece, {q.md5_list('t')} AS tokens_md5 FROM parts"""
)
def text_corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text files as one stream: nine tenths train, the rest validates; stored and read back."""
    folder = scratch_path(spark, "text-files")
    write_text_corpus(documents(spark, sf_dir, "doc_id", "text"), folder)
    docs = read_text_corpus(spark, folder)
    path = scratch_path(spark, "text-shards")
    write_token_shards(pack.two_way_split(pack.place_documents(docs, BYTES), BYTES), path)
    stored = read_token_shards(spark, path)
    return stored.select(
        "split", "doc_id", "shard_pos", "n_piece", digest(F.col("tokens")).alias("tokens_md5")
    )
