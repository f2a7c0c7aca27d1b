"""Metric logs, schedules and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions import rates
from tokenloom.operators import metrics
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.session import scratch_root
from tokenloom.sources import corpus, logs
from tokenloom.streaming import jobs

HEADER = ",".join(fv.PRETRAIN_LOG_COLUMNS)


def test_wide_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(HEADER + "\n0,3.5,3.4,0.25,,,1e-3,1.0,10.5,0.5,12.00\n1,3.25,,,,,2e-3,1.0,10.5,0.5,12.00\n")
    rows = logs.read_log(spark, str(path), "r").collect()
    long = {(r["stream"], r["step"]): r["value"] for r in rows}
    assert long[("hella", 0)] == 0.25 and long[("train", 1)] == 3.25 and long[("lr", 1)] == 2e-3
    assert ("val", 1) not in long and not any(s in ("mmlu", "arc") for s, _ in long)
    assert {r["run"] for r in rows} == {"r"}


def test_short_log_lacks_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(",".join(fv.SFT_LOG_COLUMNS) + "\n5,1.5,,2e-5,1.0,10.0,3.0\n")
    rows = logs.read_log(spark, str(path), "r", fv.SFT_LOG_COLUMNS).collect()
    assert {r["stream"] for r in rows} == {"train", "lr", "grad_norm", "tokens_per_sec", "dt_ms"}


def test_line_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("5 val 3.1\n5 val 3.0\n5 val\n  6 train 2.5 extra\n\n7  val 1\n")
    with pytest.raises(Exception):
        logs.read_log(spark, str(path), "r").collect()  # "7  val 1": the value is "val"
    path.write_text("5 val 3.1\n5 val 3.0\n5 val\n  6 train 2.5 extra\n\n")
    got = {(r["stream"], r["step"]): r["value"] for r in logs.read_log(spark, str(path), "r").collect()}
    assert got == {("val", 5): 3.0, ("train", 6): 2.5}
    path.write_text("5 val abc\n")
    with pytest.raises(Exception):
        logs.read_log(spark, str(path), "r").collect()


def test_last_line_wins_across_file_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"1 val {i}.0\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert logs.read_log(spark, str(path), "r").first()["value"] == 4999.0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_log_text_form(spark, tmp_path):
    schema = logs.log_schema()
    row = [(3, 1.23456789, None, 0.25, None, None, 0.0024, 1.0, 1234.5, 0.5, 12.0)]
    r = metrics.rounded_log(spark.createDataFrame(row, schema)).first()
    assert list(r) == ["3", "1.234568", "", "0.2500", "", "", "2.400000e-03", "1.0000", "1234.50", "0.500000", "12.00"]
    path = str(tmp_path / "log.csv")
    for _ in range(2):
        logs.append_log(spark.createDataFrame(row, schema), path)
    assert logs.read_wide_log(spark, path, "r").count() == 2


def expected_rate(step, max_lr, min_lr, warmup_steps, max_steps):
    if step < warmup_steps:
        return max_lr * (step + 1) / warmup_steps
    if step > max_steps:
        return min_lr
    share = (step - warmup_steps) / (max_steps - warmup_steps)
    return min_lr + 0.5 * (1 + math.cos(math.pi * share)) * (max_lr - min_lr)


def test_learning_rate(spark):
    steps = [0, 1, 356, 357, 358, 20000, 39999, 40000, 40001]
    df = spark.createDataFrame([(s,) for s in steps], "step bigint")
    got = df.select("step", rates.learning_rate(F.col("step"), **fv.PRETRAIN_SCHEDULE).alias("lr")).collect()
    for r in got:
        assert r["lr"] == pytest.approx(expected_rate(r["step"], **fv.PRETRAIN_SCHEDULE))
    flat = rates.learning_rate(F.col("step"), max_steps=10, constant=True, **fv.SFT_SCHEDULE)
    assert {r[0] for r in df.select(flat).collect()} == {2e-5}


def test_batch_divisibility():
    assert rates.accumulation_steps(524_288, 16, 1024, 2) == 16
    with pytest.raises(ValueError):
        rates.accumulation_steps(524_288, 12, 1024, 2)


def test_latest_values_over_growing_log(spark, tmp_path):
    """Each flush is a new file; the stream agrees with the batch result after every one."""
    folder = tmp_path / "logs"
    folder.mkdir()
    schema = logs.log_schema()
    for k in range(3):
        (folder / f"part{k}.csv").write_text(f"{HEADER}\n{k},{3 - k},,,,,1e-3,1,1,1,1\n")
        stream = jobs.stream_files(spark, str(folder), schema, format="csv", header="true", maxFilesPerTrigger="1")
        got = jobs.run_to_table(jobs.latest_log_values(stream.withColumn("run", F.lit("r"))), "t")
        batch = jobs.latest_values(logs.read_log(spark, str(folder) + "/*.csv", "r"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert {r["stream"]: r["last_value"] for r in got.collect()}["train"] == 1.0


def test_streamed_counts_equal_batch(spark, sf_dir, tmp_path):
    docs = spark.read.schema(corpus.CORPUS_SCHEMA).parquet(f"{sf_dir}/documents.parquet")
    folder = str(tmp_path / "docs")
    docs.repartition(5, "doc_id").write.parquet(folder)
    stream = jobs.stream_files(spark, folder, corpus.CORPUS_SCHEMA, pattern="*.parquet", maxFilesPerTrigger="2")
    got = jobs.run_to_table(jobs.token_counts_by_source(stream, ByteTokenizer()), "t")
    want = jobs.token_counts_by_source(docs, ByteTokenizer())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scratch_follows_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_root(spark).startswith(named.rstrip("/"))


def test_sized_corpus(spark, tmp_path):
    spark.createDataFrame([(0, "t", "en", "s", 1)], corpus.CORPUS_SCHEMA).write.parquet(str(tmp_path / "sample-10BT"))
    assert corpus.read_sized_corpus(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        corpus.read_sized_corpus(spark, str(tmp_path), "1BT")


def test_step_times_add_up_after_every_append(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"r{i % 2}", None if i % 17 == 0 else float(t)) for i, t in enumerate(rng.integers(1, 400, 600))]
    path, shares = str(tmp_path / "times"), {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    for n, part in enumerate(["a", "b", "c", "c"]):
        at = min(n, 2) * 200
        piece = spark.createDataFrame(rows[at : at + 200], "run string, dt_ms double")
        logs.append_step_times(piece, path, part)
        found = metrics.speed_summary(logs.read_step_times(spark, path), 1000, shares).collect()
        for run in found:
            times = np.array([t for r, t in rows[: at + 200] if r == run["run"] and t is not None])
            assert run["n_steps"] == len(times)
            assert run["tokens_per_sec"] == pytest.approx(1e6 * len(times) / times.sum())
            for name, share in shares.items():
                assert run[name] == pytest.approx(np.quantile(times, share))
    empty = spark.createDataFrame([], "run string, dt_ms double")
    assert metrics.speed_summary(metrics.step_times(empty), 1000, shares).count() == 0
