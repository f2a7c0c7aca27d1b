"""Metric logs of training runs: one long layout, and comparisons on it.

Long layout: ``(run, stream, step, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.rates import flops_utilisation, learning_rate, throughput


def long_from_wide(wide: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Melt the measured columns; missing columns and empty cells give no rows.

    Where the log has a ``line_no``, a repeated step keeps its last measured value.
    """
    names = columns or fv.STREAM_OF_COLUMN
    present = [c for c in names if c in wide.columns]
    keys = ["run", "step", *[c for c in ("line_no",) if c in wide.columns]]
    rows = wide.select(*keys, *[F.col(c).cast("double").alias(names[c]) for c in present])
    melted = rows.unpivot(keys, [names[c] for c in present], "stream", "value")
    measured = melted.where(F.col("value").isNotNull())
    if "line_no" in keys:
        last = F.max_by("value", "line_no").alias("value")
        measured = measured.groupBy("run", "stream", "step").agg(last)
    return measured.select("run", "stream", "step", "value")


def long_from_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """``step stream value`` lines; a repeated step keeps its last line.

    Lines with fewer than three parts are skipped; a step or value that is not a
    number is an error.
    """
    parts = F.split(F.btrim(F.col("line"), F.lit(fv.PYTHON_WHITESPACE)), " ")
    parsed = (
        lines.select("run", order, parts.alias("p"))
        .where(F.size("p") >= 3)
        .select(
            "run",
            order,
            F.get("p", F.lit(1)).alias("stream"),
            F.get("p", F.lit(0)).cast("bigint").alias("step"),
            F.get("p", F.lit(2)).cast("double").alias("value"),
        )
    )
    return parsed.groupBy("run", "stream", "step").agg(F.max_by("value", order).alias("value"))


def stream_sizes(long: DataFrame) -> DataFrame:
    return long.groupBy("run", "stream").agg(F.count(F.lit(1)).alias("n_entries"))


def headline(long: DataFrame) -> DataFrame:
    """Last, lowest and highest value of every stream."""
    return long.groupBy("run", "stream").agg(
        F.max("step").alias("last_step"),
        F.max_by("value", "step").alias("last_value"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


def baseline_table(spark) -> DataFrame:
    return spark.createDataFrame(
        fv.PUBLISHED_BASELINES, "size string, stream string, family string, baseline double"
    )


def against_baselines(values: DataFrame, baselines: DataFrame, size: str) -> DataFrame:
    """Distance of each value from each published score of one size."""
    chosen = baselines.where(F.col("size") == size).select("stream", "family", "baseline")
    return values.join(chosen, "stream").withColumn(
        "difference", F.col("value") - F.col("baseline")
    )


def aligned_runs(long: DataFrame, runs: list[str]) -> DataFrame:
    """One column per run on a common step axis."""
    return (
        long.groupBy("stream", "step")
        .pivot("run", runs)
        .agg(F.first("value"))
    )


def in_plot_order(long: DataFrame) -> DataFrame:
    return long.orderBy("run", "stream", "step")


def learning_rate_audit(log: DataFrame, **schedule) -> DataFrame:
    """Expected rate beside the logged one."""
    expected = learning_rate(F.col("step"), **schedule)
    return log.withColumn("expected_lr", expected).withColumn(
        "difference", F.col("lr") - F.col("expected_lr")
    )


def run_speed(log: DataFrame, tokens: int, parameters: int, world: int) -> DataFrame:
    """Tokens per second and share of peak FLOPs of each logged step (``dt_ms``)."""
    seconds = F.col("dt_ms") / F.lit(1000.0)
    return log.withColumn("tokens_per_sec", throughput(tokens, seconds)).withColumn(
        "mfu", flops_utilisation(tokens, seconds, parameters, fv.PEAK_FLOPS, world)
    )


def step_times(log: DataFrame) -> DataFrame:
    """How often each run took each whole number of milliseconds for a step.

    ``(run, dt_ms, n)``: one row per run and distinct time, however many steps there are.
    Such tables of several parts of a log add up (``sources.logs.read_step_times``). Steps
    without a time do not count; times are rounded to the nearest whole number.
    """
    whole = F.round(F.col("dt_ms").cast("double")).cast("bigint")
    timed = log.select("run", whole.alias("dt_ms")).where(F.col("dt_ms").isNotNull())
    return timed.groupBy("run", "dt_ms").agg(F.count(F.lit(1)).alias("n"))


def speed_summary(times: DataFrame, tokens: int, shares: dict[str, float]) -> DataFrame:
    """Steps, mean tokens per second and percentiles of the step time of every run.

    The mean is all tokens over all time; ``shares`` names the percentiles, which are exact.
    Null where a run took no time at all.
    """
    total = F.sum(F.col("dt_ms") * F.col("n"))
    found = [F.percentile("dt_ms", F.lit(share), F.col("n")).alias(name) for name, share in shares.items()]
    return times.groupBy("run").agg(
        F.sum("n").alias("n_steps"),
        F.try_divide(F.sum("n") * F.lit(1000.0 * tokens), total).alias("tokens_per_sec"),
        *found,
    )


def rounded_log(log: DataFrame) -> DataFrame:
    """Text form of a log row: fixed digits per column, empty where nothing was measured."""

    def text(name: str) -> Column:
        if name not in fv.LOG_FORMATS:
            return F.col(name).cast("string")
        digits, scientific = fv.LOG_FORMATS[name]
        pattern = f"%.{digits}{'e' if scientific else 'f'}"
        written = F.format_string(pattern, F.col(name).cast("double"))
        return F.when(F.col(name).isNotNull(), written).otherwise("")

    return log.select(*[text(name).alias(name) for name in log.columns])
