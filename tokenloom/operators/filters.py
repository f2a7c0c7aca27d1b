"""Filter chain of instruction examples: one reason per row, no row lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.arrays import evaluated_once, let
from tokenloom.functions.text import passes_native_english_checks
from tokenloom.operators.encode import length_ok, with_token_counts
from tokenloom.operators.langid import LanguageProfile, identify
from tokenloom.operators.lookup import lookup_join
from tokenloom.operators.prefix import running_total_by_key
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.session import materialise, scratch_path


REASON_COLUMNS = ["source", "ord", "prompt_len", "response_len", "n_tokens"]


def language_text() -> Column:
    """The text whose language is tested: instruction and response, not the context."""
    return F.concat(F.col("instruction"), F.lit(" "), F.col("response"))


def _with_native_checks(examples: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    return evaluated_once(
        with_token_counts(examples, tokenizer),
        ["*"],
        native_ok=let(language_text(), passes_native_english_checks),
    )


def skip_reasons(
    examples: DataFrame,
    tokenizer: Tokenizer,
    *,
    profile: LanguageProfile | None = None,
    wanted: str = "en",
    max_chars: int | None = None,
    max_tokens: int = fv.SEQUENCE_TOKENS,
    min_response: int = fv.MIN_RESPONSE_TOKENS,
) -> DataFrame:
    """``(source, ord, prompt_len, response_len, n_tokens, skip_reason)``, one row per example.

    The reason is ``fmt``, ``lang`` or ``len``, the first that applies, or NULL for
    a kept row. ``(source, ord)`` has to identify a row. The language job sees only
    texts that passed the cheap checks, and no text is shuffled. Without a profile
    that stage is left out.
    """
    staged = _with_native_checks(examples, tokenizer).withColumn(
        "unusable", F.col("instruction").isNull()
    )
    narrow = [*REASON_COLUMNS, "unusable", "native_ok"]
    english = F.col("native_ok")
    if profile is None:
        rows = staged.select(*narrow)
    else:
        survivors = staged.select(
            *narrow, F.when(F.col("native_ok"), language_text()).alias("language_text")
        )
        rows = identify(
            survivors, profile, keys=narrow, text="language_text", max_chars=max_chars
        )
        english = english & F.coalesce(F.col("language") == wanted, F.lit(False))
    reason = (
        F.when(F.col("unusable"), F.lit("fmt"))
        .when(~english, F.lit("lang"))
        .when(~length_ok(max_tokens, min_response), F.lit("len"))
    )
    return rows.select(*REASON_COLUMNS, reason.alias("skip_reason"))


def kept_examples(
    examples: DataFrame,
    tokenizer: Tokenizer,
    *,
    kept_keys: DataFrame | None = None,
    max_tokens: int = fv.SEQUENCE_TOKENS,
    min_response: int = fv.MIN_RESPONSE_TOKENS,
) -> DataFrame:
    """The kept examples with their texts and token counts.

    The cheap checks run again and drop most rows where they are. What only the
    language job or the cap can tell comes in as ``kept_keys``, the ``(source,
    ord)`` of kept rows, so that texts are shuffled for likely rows alone.
    """
    likely = _with_native_checks(examples, tokenizer).where(
        F.col("native_ok") & length_ok(max_tokens, min_response)
    )
    if kept_keys is not None:
        keys = ["source", "ord"]
        likely = likely.join(kept_keys.select(*keys), keys, "left_semi")
    return likely.drop("native_ok")


def cap_per_source(
    reasoned: DataFrame,
    cap: int = fv.SOURCE_CAP,
    *,
    bounds_from: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Keep each source's rows up to and including its ``cap``-th kept one (0: all).

    Later rows disappear altogether, so that they are neither kept nor counted.
    """
    if not cap:
        return reasoned
    counted = running_total_by_key(
        reasoned,
        F.col("skip_reason").isNull().cast("int"),
        key="ord",
        by=["source"],
        out="_kept_before",
        bounds_from=bounds_from,
        buckets=buckets,
    )
    return counted.where(F.coalesce("_kept_before", F.lit(0)) < cap).drop("_kept_before")


#: Rows of a source that the first round looks at, as a multiple of the cap.
FIRST_ROUND = 8
#: Growth of the range where a source has kept nothing so far, and spare rows otherwise.
BLIND_GROWTH, SPARE = 16, 1.25
#: Ranges end at one of these shares of a source's rows: halves of halves.
HALVINGS = 14


def capped_reasons(
    examples: DataFrame,
    tokenizer: Tokenizer,
    *,
    cap: int = fv.SOURCE_CAP,
    profile: LanguageProfile | None = None,
    buckets: int | None = None,
    **options,
) -> DataFrame:
    """``skip_reasons`` of each source's rows up to and including its ``cap``-th kept one (0: all).

    The boundary of a source is found in rounds. One pass over the keys cuts its ``ord``
    values into ranges, about halves of halves; a round tests the next ranges of every source
    that is not done, and the share kept so far says how far the following one has to reach.
    Texts beyond the last range are neither tested nor tokenised. Ranges decide what is
    tested, never the result. They are compared where the text is, so no text is shuffled.
    ``examples`` is read for its keys and once a round: store it first unless it is a plain
    scan. ``(source, ord)`` has to identify a row, and neither may be NULL.
    """
    if not cap:
        return skip_reasons(examples, tokenizer, profile=profile, **options)
    spark = examples.sparkSession
    shares = [2.0**-i for i in reversed(range(HALVINGS))]
    marks = F.percentile_approx("ord", shares, 2 ** (HALVINGS + 1))
    # One row per source: ranges up to mark ``low`` are tested, up to ``high`` are next.
    state = examples.select("source", "ord").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"), marks.alias("marks")
    )
    state = state.withColumn("kept", F.lit(0).cast("bigint")).withColumn("low", F.lit(0))
    state = materialise(
        state.withColumn("high", _mark_at(F.lit(float(FIRST_ROUND * cap)), F.col("low"))), "ranges"
    )
    path = scratch_path(spark, "reasons")
    while True:
        ends = state.select(
            "source",
            F.get("marks", F.col("low") - 1).alias("after"),
            F.when(F.col("high") == HALVINGS, F.col("last"))
            .otherwise(F.get("marks", F.col("high") - 1))
            .alias("until"),
        )
        inside = lookup_join(examples, ends, ["source"], spread_by=F.col("ord")).where(
            (F.col("ord") <= F.col("until"))
            & (F.col("after").isNull() | (F.col("ord") > F.col("after")))
        )
        found = skip_reasons(
            inside.select(*examples.columns), tokenizer, profile=profile, **options
        )
        found.write.mode("append").parquet(path)
        reasons = spark.read.parquet(path)
        kept = (
            reasons.where(F.col("skip_reason").isNull())
            .groupBy("source")
            .agg(F.count(F.lit(1)).alias("kept"))
        )
        missing = F.lit(cap) - F.col("kept")
        tested = F.col("n") * F.element_at(F.lit(shares), F.col("high"))
        reach = F.when(F.col("kept") == 0, tested * BLIND_GROWTH).otherwise(
            tested + SPARE * missing * tested / F.col("kept")
        )
        state = (
            state.drop("kept")
            .join(kept, "source", "left")
            .withColumn("kept", F.coalesce("kept", F.lit(0).cast("bigint")))
            .where((missing > 0) & (F.col("high") < HALVINGS))
            .withColumn("low", F.col("high"))
            .withColumn("high", _mark_at(reach, F.col("low")))
        )
        state = materialise(state, "ranges")
        if state.isEmpty():
            return cap_per_source(reasons, cap, buckets=buckets)


def _mark_at(rows: Column, low: Column) -> Column:
    """Number of the first mark above ``low`` with at least so many rows up to it."""
    halvings = F.floor(F.log2(F.greatest(F.col("n") / rows, F.lit(1.0)))).cast("int")
    return F.least(F.greatest(F.lit(HALVINGS) - halvings, low + 1), F.lit(HALVINGS))


def skip_stats(reasoned: DataFrame) -> DataFrame:
    """Kept and skipped rows per source, and in total (``source`` NULL)."""
    reason = F.col("skip_reason")
    return reasoned.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"),
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason == "lang").alias("skipped_not_english"),
        F.count_if(reason == "len").alias("skipped_too_long_or_short"),
        F.count_if(reason == "fmt").alias("skipped_format"),
    )
