"""Queries: multiple-choice items, candidate scores, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import digest
from tokenloom.operators import choices, losses, pack, windows
from tokenloom.operators.tokenizers import ByteTokenizer, with_leading_delimiter
from tokenloom.plans import mix, packing
from tokenloom.plans import sqltext as q
from tokenloom.plans.catalog import documents, query, table
from tokenloom.session import materialise, scratch_path
from tokenloom.sources import benchmarks
from tokenloom.sources.reports import write_science_items

BYTES = ByteTokenizer()
N_CHOICES, STRIDE = 4, 7
KEYS = ["answer A", "2", " C ", "z"]

# ---------------------------------------------------------------------------------------
# Items from the benchmark table: the question is an item's own text, the candidates are
# the texts of the items 0, 7, 14 and 21 further on (counted in a circle).


def _four_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, question, a, b, c, d)``; at most four rows meet per item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n = items.agg(F.count(F.lit(1))).scalar()
    wanted = items.select(
        F.col("item_id").alias("for_item"),
        F.posexplode(F.array(*[F.lit(k * STRIDE) for k in range(N_CHOICES)])).alias("k", "step"),
    ).withColumn("item_id", (F.col("for_item") + F.col("step")) % n)
    found = wanted.join(items, "item_id")
    columns = [
        F.max(F.when(F.col("k") == k, F.col("text"))).alias(c) for k, c in enumerate("abcd")
    ]
    texts = found.groupBy("for_item").agg(*columns).withColumnRenamed("for_item", "item_id")
    return items.withColumnRenamed("text", "question").join(texts, "item_id")


def _by_id(values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod("item_id", F.lit(len(values))).cast("int"))


def _completion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four_choices(spark, sf_dir).select(
        F.col("item_id").alias("ind"),
        F.col("question").alias("ctx"),
        (F.col("item_id") % 4).cast("int").alias("label"),
        F.array("a", "b", "c", "d").alias("endings"),
    )


LETTERS = [" A", "B ", "C", " D "]
FOUR_SQL = f"""
n AS (SELECT count(*) AS n FROM benchmark),
w AS (SELECT item_id AS for_item, k, (item_id + k * {STRIDE}) % (SELECT n FROM n) AS item_id
      FROM benchmark, range({N_CHOICES}) r(k)),
t AS (SELECT for_item, max(CASE WHEN k = 0 THEN text END) AS a, max(CASE WHEN k = 1 THEN text END) AS b,
             max(CASE WHEN k = 2 THEN text END) AS c, max(CASE WHEN k = 3 THEN text END) AS d
      FROM w JOIN benchmark USING (item_id) GROUP BY 1),
four AS (SELECT item_id, text AS question, a, b, c, d FROM benchmark JOIN t ON for_item = item_id)"""


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _items_view(items: DataFrame) -> DataFrame:
    return items.select(
        "bench",
        "item_id",
        "subject",
        F.md5("ctx").alias("ctx_md5"),
        F.md5(F.array_join("candidates", "\x1f")).alias("candidates_md5"),
        F.col("label").cast("bigint").alias("label"),
    )


COMPLETION_SQL = """
items AS (SELECT 'hellaswag' AS bench, item_id::VARCHAR AS item_id, NULL::VARCHAR AS subject, question AS ctx,
                 [' ' || a, ' ' || b, ' ' || c, ' ' || d] AS candidates, item_id % 4 AS label FROM four)"""
VIEW_SQL = """SELECT bench, item_id, subject, md5(ctx) AS ctx_md5,
       md5(array_to_string(candidates, chr(31))) AS candidates_md5, label FROM items"""


@query(f"WITH {FOUR_SQL},{COMPLETION_SQL} {VIEW_SQL}")
def mcq_completion_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as JSON lines and read back through the benchmark registry."""
    path = scratch_path(spark, "completion")
    _completion_rows(spark, sf_dir).write.json(path)
    return _items_view(benchmarks.read_items(spark, "hellaswag", path))


SUBJECTS = fv.CURATED_SUBJECTS + ["astronomy"]
SUBJECT_SQL = f"""
rows AS (SELECT *, ({_sql_list(SUBJECTS)})[(item_id % {len(SUBJECTS)})::INT + 1] AS subject,
                ({_sql_list(LETTERS)})[(item_id % 4)::INT + 1] AS answer FROM four),
titled AS (SELECT *, list_transform(string_split(subject, '_'), lambda s: upper(s[1]) || lower(s[2:])) AS words FROM rows),
items AS (
  SELECT 'mmlu' AS bench, md5(concat_ws(chr(31), subject, question, a, b, c, d, answer)) AS item_id, subject,
         'The following are multiple choice questions (with answers) about ' || array_to_string(words, ' ') ||
         '.' || chr(10) || chr(10) || question || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) ||
         'C. ' || c || chr(10) || 'D. ' || d || chr(10) || 'Answer:' AS ctx,
         [' A. ' || a, ' B. ' || b, ' C. ' || c, ' D. ' || d] AS candidates, item_id % 4 AS label
  FROM titled)"""


@query(f"WITH {FOUR_SQL},{SUBJECT_SQL} {VIEW_SQL} WHERE subject <> 'astronomy'")
def mcq_subject_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file per subject, subject from the file name, curated subjects only."""
    rows = (
        _four_choices(spark, sf_dir)
        .withColumn("subject", _by_id(SUBJECTS))
        .withColumn("answer", _by_id(LETTERS))
        .select("subject", "question", "a", "b", "c", "d", "answer")
    )
    cells = [_csv_cell(c) for c in ("question", "a", "b", "c", "d", "answer")]
    root = _subject_files(spark, rows.select("subject", F.concat_ws(",", *cells).alias("line")))
    return _items_view(benchmarks.read_items(spark, "mmlu", root))


def _csv_cell(name: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('"'))


def _subject_files(spark: SparkSession, lines: DataFrame) -> str:
    """Store ``(subject, line)`` as ``test/<subject>_test.csv``, one job for each of the few names."""
    root = scratch_path(spark, "subjects")
    stored = materialise(lines, "subject-lines")
    for subject in SUBJECTS:
        own = stored.where(F.col("subject") == subject).select("line")
        own.write.text(f"{root}/test/{subject}_test.csv")
    return root


REJECT_SQL = f"""
SELECT subject, subject || '_test.csv' AS file, item_id % 11 = 0 OR item_id % 13 = 0 AS rejected,
       CASE WHEN item_id % 11 = 0 THEN 'fields' WHEN item_id % 13 = 0 THEN 'answer' END AS reject,
       md5(question || chr(31) || a || chr(31) || d) AS content_md5,
       (SELECT count(*) FROM rows WHERE subject <> 'astronomy') AS n_rows,
       (SELECT count(*) FROM rows WHERE subject <> 'astronomy' AND item_id % 11 = 0) AS n_fields,
       (SELECT count(*) FROM rows WHERE subject <> 'astronomy' AND item_id % 11 <> 0 AND item_id % 13 = 0) AS n_answer
FROM rows WHERE subject <> 'astronomy'"""


@query(f"WITH {FOUR_SQL},{SUBJECT_SQL} {REJECT_SQL}")
def mcq_subject_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and rejects of files in which some rows lack the answer and some name no choice."""
    short, odd = F.col("item_id") % 11 == 0, F.col("item_id") % 13 == 0
    rows = (
        _four_choices(spark, sf_dir)
        .withColumn("subject", _by_id(SUBJECTS))
        .withColumn("answer", F.when(odd, F.lit("E")).otherwise(_by_id(LETTERS)))
    )
    texts = [_csv_cell(c) for c in ("question", "a", "b", "c", "d")]
    answer = F.when(~short, _csv_cell("answer"))  # a null leaves the field out
    root = _subject_files(spark, rows.select("subject", F.concat_ws(",", *texts, answer).alias("line")))
    path = scratch_path(spark, "judged-subjects")
    seen = benchmarks.store_judged(benchmarks.judged_subjects(spark, root), path)
    stored = spark.read.parquet(path)
    return stored.select(
        "subject",
        "file",
        F.col("rejected").cast("boolean").alias("rejected"),
        "reject",
        F.md5(F.concat_ws("\x1f", "question", "a", "d")).alias("content_md5"),
        F.lit(seen["rows"]).alias("n_rows"),
        F.lit(seen["fields"]).alias("n_fields"),
        F.lit(seen["answer"]).alias("n_answer"),
    )


SCIENCE_SQL = """
rows AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN ['A', 'B', 'C', 'D'] ELSE ['1', '2', '3', '4'] END AS labels,
                (['B', '3', '2', 'Z', 'E'])[(item_id % 5)::INT + 1] AS key,
                ([1, 2, 1, 0, 4])[(item_id % 5)::INT + 1] AS fallback FROM four),
items AS (
  SELECT 'arc' AS bench, 'Q' || item_id AS item_id, NULL::VARCHAR AS subject,
         question || chr(10) || labels[1] || '. ' || a || chr(10) || labels[2] || '. ' || b || chr(10) ||
         labels[3] || '. ' || c || chr(10) || labels[4] || '. ' || d || chr(10) || 'Answer:' AS ctx,
         [' ' || labels[1] || '. ' || a, ' ' || labels[2] || '. ' || b, ' ' || labels[3] || '. ' || c,
          ' ' || labels[4] || '. ' || d] AS candidates,
         coalesce(list_position(labels, key) - 1, fallback)::BIGINT AS label FROM rows)"""


def _science_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    digits = F.array(*[F.lit(x) for x in "1234"])
    return _four_choices(spark, sf_dir).select(
        "item_id",
        F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("id"),
        "question",
        F.struct(
            F.array("a", "b", "c", "d").alias("text"),
            F.when(F.col("item_id") % 2 == 0, letters).otherwise(digits).alias("label"),
        ).alias("choices"),
        _by_id(["B", "3", "2", "Z", "E"]).alias("answerKey"),
    )


@query(f"WITH {FOUR_SQL},{SCIENCE_SQL} {VIEW_SQL}")
def mcq_science_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten flat rows as JSON, unpacked, stored as nested lines, and read back."""
    page = F.call_function("div", F.col("item_id"), F.lit(10)) * 10
    row = F.struct("id", "question", "choices", "answerKey")
    pages = (
        _science_flat(spark, sf_dir)
        .select(page.alias("offset"), F.struct(F.col("item_id"), row.alias("row")).alias("entry"))
        .groupBy("offset")
        .agg(F.array_sort(F.collect_list("entry")).alias("rows"))
    )
    raw, nested = scratch_path(spark, "pages"), scratch_path(spark, "science")
    pages.write.json(raw)
    stored = benchmarks.read_science_pages(spark, raw, multi_line=False)
    write_science_items(choices.nested_science_rows(stored), nested)
    return _items_view(benchmarks.read_items(spark, "arc", nested))


CANDIDATE_SQL = f"""{FOUR_SQL},{COMPLETION_SQL},
cand AS (
  SELECT item_id, label, cand_idx, {q.byte_list('ctx')} AS ct, {q.byte_list('candidate')} AS dt
  FROM (SELECT item_id, label, ctx, unnest(candidates) AS candidate, unnest(range(4)) AS cand_idx FROM items)),
tok_rows AS (
  SELECT *, ct || dt AS toks,
         list_transform(ct, lambda z: 0) || list_transform(dt, lambda z: 1) AS mask FROM cand)"""


@query(
    f"""WITH {CANDIDATE_SQL},
wide AS (SELECT *, max(len(toks)) OVER (PARTITION BY item_id) AS w FROM tok_rows)
SELECT item_id, cand_idx, label, {q.md5_list('toks || list_transform(range(w - len(toks)), lambda z: 0)')} AS tokens_md5,
       {q.md5_list('mask || list_transform(range(w - len(toks)), lambda z: 0)')} AS mask_md5 FROM wide"""
)
def mcq_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = choices.completion_items(_completion_rows(spark, sf_dir))
    return choices.collated(choices.candidate_tokens(items, BYTES)).select(
        "item_id",
        F.col("cand_idx").cast("bigint").alias("cand_idx"),
        F.col("label").cast("bigint").alias("label"),
        digest(F.col("tokens")).alias("tokens_md5"),
        digest(F.col("mask")).alias("mask_md5"),
    )


# ---------------------------------------------------------------------------------------
# The counting scorer: next-token counts of the whole corpus.


def _corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        with_leading_delimiter(BYTES, F.col("text")).alias("tokens")
    )
    return materialise(losses.next_token_counts(rows), "pair-counts")


COUNTS_SQL = f"""
dt AS (SELECT [256] || {q.byte_list('text')} AS toks FROM documents),
bigrams AS (SELECT unnest(toks[:-2]) AS prev, unnest(toks[2:]) AS next FROM dt),
pc AS (SELECT prev, next, count(*) AS n FROM bigrams GROUP BY 1, 2),
ctx AS (SELECT prev, sum(n) AS total FROM pc GROUP BY 1)"""


def _loss_sql(source: str) -> str:
    """Adds ``loss`` to rows with ``prev`` and ``next``."""
    return f"""(SELECT s.*, coalesce(-ln((coalesce(pc.n, 0) + 1.0::DOUBLE) / (ctx.total + 257.0::DOUBLE)),
        ln(257.0::DOUBLE)) AS loss
  FROM {source} s LEFT JOIN ctx ON ctx.prev = s.prev LEFT JOIN pc ON pc.prev = s.prev AND pc.next = s.next)"""


SCORES_SQL = f"""{CANDIDATE_SQL},{COUNTS_SQL},
steps AS (SELECT item_id, cand_idx, unnest(toks[:-2]) AS prev, unnest(toks[2:]) AS next,
                 unnest(mask[2:]) AS m FROM tok_rows),
scored AS (SELECT item_id, cand_idx, sum(loss * m) / sum(m) AS avg_loss FROM {_loss_sql('steps')} GROUP BY 1, 2)"""


@query(f"WITH {COUNTS_SQL} SELECT prev::BIGINT AS prev, next::BIGINT AS next, n FROM pc")
def next_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_counts(spark, sf_dir).select(
        F.col("prev").cast("bigint").alias("prev"), F.col("next").cast("bigint").alias("next"), "n"
    )


def _scores(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    score = losses.counting_scorer(
        _corpus_counts(spark, sf_dir), BYTES.vocab_size, ["bench", "item_id", "cand_idx"]
    )
    return choices.candidate_scores(score(choices.candidate_tokens(items, BYTES)))


@query(
    f"""WITH {SCORES_SQL} SELECT item_id, cand_idx, round(avg_loss, 6) AS avg_loss FROM scored"""
)
def mcq_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = choices.completion_items(_completion_rows(spark, sf_dir))
    return _scores(spark, sf_dir, items).select(
        "item_id",
        F.col("cand_idx").cast("bigint").alias("cand_idx"),
        F.round("avg_loss", 6).alias("avg_loss"),
    )


@query(
    f"""WITH {SCORES_SQL},
best AS (SELECT item_id, arg_min(cand_idx, (avg_loss, cand_idx)) AS predicted FROM scored GROUP BY 1),
joined AS (SELECT item_id::BIGINT % 2 AS rank, predicted, label FROM best JOIN items USING (item_id))
SELECT rank, count(*) AS n_items, sum((predicted = label)::INT)::BIGINT AS n_correct,
       sum((predicted = label)::INT)::DOUBLE / count(*) AS accuracy FROM joined GROUP BY 1
UNION ALL SELECT NULL, count(*), sum((predicted = label)::INT)::BIGINT,
       sum((predicted = label)::INT)::DOUBLE / count(*) FROM joined"""
)
def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of two round-robin workers, and of both together."""
    items = choices.completion_items(_completion_rows(spark, sf_dir))
    predicted = materialise(choices.predictions(_scores(spark, sf_dir, items)), "predictions")
    numbered = items.withColumn("ordinal", F.col("item_id").cast("bigint"))
    parts = [
        choices.accuracy(predicted, choices.on_rank(numbered, "ordinal", rank, 2), ["bench"])
        .withColumn("rank", F.lit(rank).cast("bigint"))
        for rank in range(2)
    ]
    whole = choices.accuracy(predicted, items, ["bench"]).withColumn(
        "rank", F.lit(None).cast("bigint")
    )
    both = parts[0].unionByName(parts[1]).unionByName(whole)
    return both.select("rank", "n_items", "n_correct", "accuracy")


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS z FROM embeddings)
SELECT vec_id, round(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) -
             z[(label % len(z))::INT + 1], 6) AS loss FROM v"""
)
def xent_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "target", F.col("label") % F.size("embedding")
    )
    return losses.losses_from_logits(rows, "embedding", "target").select(
        "vec_id", F.round("loss", 6).alias("loss")
    )


# ---------------------------------------------------------------------------------------
# Validation losses.


@query(
    f"""WITH {q.placed(packing.SHARD)},{q.windows(packing.SHARD, packing.WINDOW)},
{q.stream_tokens(packing.SHARD)},{q.window_lists(packing.SHARD, packing.WINDOW)},{COUNTS_SQL},
ordered AS (SELECT toks, (row_number() OVER (ORDER BY shard_id, win) - 1) // {packing.BATCH} AS batch_id,
                   count(*) OVER () AS total FROM wins WHERE shard_id = 0),
st AS (SELECT batch_id, unnest(toks[:-2]) AS prev, unnest(toks[2:]) AS next FROM ordered
       WHERE batch_id < least({fv.VALIDATION_BATCHES}, total // {packing.BATCH})),
means AS (SELECT batch_id, avg(loss) AS m FROM {_loss_sql('st')} GROUP BY 1)
SELECT count(*) AS n_batches, round(avg(m), 6) AS loss FROM means"""
)
def val_loss_mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batches of the validation pass; how many is part of the measure."""
    score = losses.counting_scorer(_corpus_counts(spark, sf_dir), BYTES.vocab_size, ["batch_id"])
    picked = _validation_batches(spark, sf_dir, packing.BATCH)
    return losses.mean_of_batch_means(score(picked), fv.VALIDATION_BATCHES).select(
        "n_batches", F.round("loss", 6).alias("loss")
    )


def _validation_batches(spark: SparkSession, sf_dir: str, batch_rows: int) -> DataFrame:
    """Windows of the first validation batches; documents beyond them are not tokenised.

    The pass keeps the stream's order and the first shard is all of it, so its windows'
    numbers are their places.
    """
    end = min(packing.SHARD, fv.VALIDATION_BATCHES * batch_rows * packing.WINDOW + 1)
    placed = pack.within(packing._placed(spark, sf_dir), end)
    fragments = pack.shard_fragments(placed, BYTES, packing.SHARD).where(F.col("split") == "val")
    rows = windows.window_tokens(materialise(fragments, "fragments"), packing.WINDOW)
    summary = pack.shard_summary(pack.shard_pieces(placed, packing.SHARD))
    lengths = summary.where(F.col("split") == "val").select("split", "shard_id", "n_tokens")
    n_rows = windows.window_index(lengths, packing.WINDOW).agg(F.count(F.lit(1))).scalar()
    order = rows.withColumn("perm_pos", F.col("win")).withColumn("n_rows", n_rows)
    served = windows.batches(order, batch_rows, 1, "n_rows")
    return served.where(F.col("batch_id") < fv.VALIDATION_BATCHES)


WIDE_BATCH = 400


@query(
    f"""WITH {q.placed(packing.SHARD)},{q.windows(packing.SHARD, packing.WINDOW)},
{q.stream_tokens(packing.SHARD)},{q.window_lists(packing.SHARD, packing.WINDOW)},{COUNTS_SQL},
ordered AS (SELECT toks, (row_number() OVER (ORDER BY shard_id, win) - 1) // {WIDE_BATCH} AS batch_id,
                   count(*) OVER () // {WIDE_BATCH} AS per FROM wins WHERE shard_id = 0),
st AS (SELECT batch_id, per, unnest(toks[:-2]) AS prev, unnest(toks[2:]) AS next FROM ordered
       WHERE batch_id < least({fv.VALIDATION_BATCHES}, per)),
means AS (SELECT batch_id, per, avg(loss) AS m FROM {_loss_sql('st')} GROUP BY 1, 2)
SELECT count(DISTINCT batch_id) AS n_batches, round(avg(m), 6) AS loss
FROM means JOIN (SELECT unnest(range({fv.VALIDATION_BATCHES})) AS g) ON batch_id = g % per"""
)
def val_loss_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches so wide that the validation pass starts again before the measure is full."""
    score = losses.counting_scorer(_corpus_counts(spark, sf_dir), BYTES.vocab_size, ["batch_id"])
    picked = _validation_batches(spark, sf_dir, WIDE_BATCH)
    return losses.mean_of_running_batches(score(picked), fv.VALIDATION_BATCHES).select(
        "n_batches", F.round("loss", 6).alias("loss")
    )


SUMS_SQL = f"""{mix.PADDED_SQL},{COUNTS_SQL},
bt AS (SELECT split, shard_id, row_id // 4 AS batch_id, t, m FROM padded),
st AS (SELECT split, shard_id, batch_id, unnest(t[:-2]) AS prev, unnest(t[2:]) AS next,
              unnest(m[2:]) AS mk FROM bt),
sums AS (SELECT split, shard_id, batch_id, sum(loss * mk) AS s, greatest(sum(mk), 1)::BIGINT AS c
         FROM {_loss_sql('st')} GROUP BY 1, 2, 3)"""


def _batch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.call_function("div", F.col("row_id"), F.lit(4)).alias("batch_id")
    rows = mix._padded(spark, sf_dir).select("split", "shard_id", batch, "tokens", "mask")
    by = ["split", "shard_id", "batch_id"]
    score = losses.counting_scorer(_corpus_counts(spark, sf_dir), BYTES.vocab_size, by)
    return losses.masked_batch_sums(score(rows), by)


@query(f"WITH {SUMS_SQL} SELECT count(*) AS n_batches, round(avg(s / c), 6) AS loss FROM sums")
def val_loss_masked_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.mean_of_masked_means(_batch_sums(spark, sf_dir)).select(
        "n_batches", F.round("loss", 6).alias("loss")
    )


@query(
    f"WITH {SUMS_SQL} SELECT sum(c)::BIGINT AS n_active, round(sum(s) / sum(c), 6) AS loss FROM sums"
)
def val_loss_token_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.token_weighted_loss(_batch_sums(spark, sf_dir)).select(
        "n_active", F.round("loss", 6).alias("loss")
    )
