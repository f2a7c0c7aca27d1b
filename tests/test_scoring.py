"""Benchmark readers, items, scores and losses."""

import csv
import json
import math

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import choices, losses
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.sources import benchmarks, reports

BYTES = ByteTokenizer()


def test_completion_file(spark, tmp_path):
    item = {"ind": 4, "ctx": "He", "label": 1, "endings": ["runs", "sits"], "split": "val"}
    (tmp_path / "v.jsonl").write_text(json.dumps(item) + "\n")
    r = benchmarks.read_items(spark, "hellaswag", str(tmp_path / "v.jsonl")).first()
    assert (r["item_id"], r["ctx"], r["candidates"], r["label"]) == ("4", "He", [" runs", " sits"], 1)


@pytest.fixture
def subject_root(tmp_path):
    folder = tmp_path / "test"
    folder.mkdir()
    with open(folder / "management_test.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(['multi\nline, "quoted"', "w", "", "y", "z", " B "])
        out.writerow(["five", "fields", "c", "d", "A"])
        out.writerow(["seven", "a", "b", "c", "d", "A", "extra"])
    with open(folder / "astronomy_test.csv", "w", newline="") as f:
        csv.writer(f).writerow(["q", "a", "b", "c", "d", "D"])
    (folder / "management_dev.csv").write_text("q,a,b,c,d,A\n")
    return str(tmp_path)


def test_subject_files(spark, subject_root):
    rows = benchmarks.read_subjects(spark, subject_root).collect()
    assert sorted(r["question"] for r in rows) == ['multi\nline, "quoted"', "seven"]
    assert {r["subject"] for r in rows} == {"management"}
    assert benchmarks.read_subjects(spark, subject_root, subjects="all").count() == 3
    assert benchmarks.read_subjects(spark, subject_root, subjects=["astronomy", "absent"]).count() == 1
    items = {r["label"]: r for r in benchmarks.read_items(spark, "mmlu", subject_root).collect()}
    assert set(items) == {0, 1}
    assert items[1]["ctx"] == (
        "The following are multiple choice questions (with answers) about Management.\n\n"
        'multi\nline, "quoted"\nA. w\nB. \nC. y\nD. z\nAnswer:'
    )
    assert items[1]["candidates"] == [" A. w", " B. ", " C. y", " D. z"]


def test_rejected_rows_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "in" / "test"
    folder.mkdir(parents=True)
    (folder / "management_test.csv").write_text('q,a,b,c,d, B\nshort,a,b,c,d\n"odd\nline",a,b,c,d,E\nlong,a,b,c,d,A,more\n')
    (folder / "astronomy_test.csv").write_text("x,a,b,c,d,A\n")
    judged = benchmarks.judged_subjects(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert benchmarks.store_judged(judged, out) == {"rows": 4, "fields": 1, "answer": 1}
    rejects = spark.read.parquet(f"{out}/rejected=true").collect()
    assert {(r["question"], r["reject"], r["file"]) for r in rejects} == {
        ("short", "fields", "management_test.csv"), ("odd\nline", "answer", "management_test.csv")
    }
    assert [r["record"] for r in rejects if r["reject"] == "fields"] == ["short,a,b,c,d"]
    items = benchmarks.with_item_ids(spark.read.parquet(f"{out}/rejected=false"))
    assert sorted(r["label"] for r in choices.subject_items(items).collect()) == [0, 1]


def test_unknown_answer_letter_is_an_error(spark):
    row = [("x", "management", "q", "a", "b", "c", "d", "E")]
    df = spark.createDataFrame(row, "item_id string, subject string, question string, a string, b string, c string, d string, answer string")
    with pytest.raises(Exception, match="unknown answer"):
        choices.subject_items(df).collect()


@pytest.mark.parametrize(
    "labels, key, want",
    [
        (["1", "2", "3", "4"], "3", 2),
        (["A", "B", "C", "D"], "2", 1),
        (["A", "B", "C"], "Z", 0),
        (["A", "B", "C", "D", "E"], "E", 4),
    ],
)
def test_science_labels(spark, tmp_path, labels, key, want):
    item = {
        "id": "q1",
        "question": {"stem": "Why?", "choices": {"text": [f"t{l}" for l in labels], "label": labels}},
        "answerKey": key,
    }
    (tmp_path / "a.jsonl").write_text(json.dumps(item) + "\n")
    r = benchmarks.read_items(spark, "arc", str(tmp_path / "a.jsonl")).first()
    assert r["label"] == want
    assert r["ctx"] == "Why?\n" + "".join(f"{l}. t{l}\n" for l in labels) + "Answer:"
    assert r["candidates"] == [f" {l}. t{l}" for l in labels]


def test_pages_end_at_the_first_empty_one(spark, tmp_path):
    def page(offset, n):
        rows = [
            {"row": {"id": f"{offset}-{k}", "question": "q", "choices": {"text": ["x"], "label": ["A"]}, "answerKey": "A"}}
            for k in range(n)
        ]
        (tmp_path / f"p{offset}.json").write_text(json.dumps({"offset": offset, "rows": rows}, indent=1))

    page(0, 2), page(2, 2), page(4, 0), page(6, 2)
    items = choices.nested_science_rows(benchmarks.read_science_pages(spark, str(tmp_path)))
    assert [r["id"] for r in items.orderBy("ord").collect()] == ["0-0", "0-1", "2-0", "2-1"]
    reports.write_science_items(items, str(tmp_path / "nested"))
    assert benchmarks.read_items(spark, "arc", str(tmp_path / "nested")).count() == 4


def test_candidates_and_padding(spark):
    df = spark.createDataFrame(
        [("b", "i", None, "ab", ["cd", "e"], 0)],
        "bench string, item_id string, subject string, ctx string, candidates array<string>, label int",
    )
    rows = choices.collated(choices.candidate_tokens(df, BYTES)).orderBy("cand_idx").collect()
    assert [r["tokens"] for r in rows] == [[97, 98, 99, 100], [97, 98, 101, 0]]
    assert [r["mask"] for r in rows] == [[0, 0, 1, 1], [0, 0, 1, 0]]


def test_lowest_mean_wins_and_ties_go_first(spark):
    rows = [("b", "i", 0, p, 2.0, 1) for p in range(3)] + [("b", "i", 1, p, 2.5, 1) for p in range(2)]
    rows += [("b", "i", 1, 9, 0.0, 0)]
    rows += [("b", "j", c, 0, 1.0, 1) for c in (2, 1)]
    df = spark.createDataFrame(rows, "bench string, item_id string, cand_idx int, pos int, loss double, mask int")
    got = choices.predictions(choices.candidate_scores(df)).collect()
    assert {r["item_id"]: r["predicted"] for r in got} == {"i": 0, "j": 1}


def test_accuracy_of_nothing_is_zero(spark):
    items = spark.createDataFrame([], "bench string, item_id string, subject string, label int")
    predicted = spark.createDataFrame([], "bench string, item_id string, predicted int")
    assert choices.accuracy(predicted, items, []).first()["accuracy"] == 0.0


def test_cross_entropy(spark):
    z, t = [1000.0, 1001.0, 999.0], 1
    df = spark.createDataFrame([(z, t)], "z array<double>, t int")
    want = math.log(sum(math.exp(v - 1001) for v in z)) + 1001 - z[t]
    assert losses.losses_from_logits(df, "z", "t").first()["loss"] == pytest.approx(want)


def test_masked_losses(spark):
    rows = [(0, 2.0, 1)] * 3 + [(1, 1.0, 1)] * 2 + [(1, 9.0, 0), (2, 5.0, 0)]
    df = spark.createDataFrame(rows, "batch_id int, loss double, mask int")
    sums = losses.masked_batch_sums(df, ["batch_id"])
    two = sums.where("batch_id < 2")
    assert losses.mean_of_masked_means(two).first()["loss"] == pytest.approx(1.5)
    assert losses.token_weighted_loss(two).first()["loss"] == pytest.approx(1.6)
    # A batch without active tokens counts as one token of loss 0.
    assert losses.token_weighted_loss(sums).first()["loss"] == pytest.approx(8 / 6)


def test_counting_scorer(spark):
    counts = spark.createDataFrame([(1, 2, 3), (1, 1, 1)], "prev int, next int, n bigint")
    score = losses.counting_scorer(counts, 4, ["k"])
    df = spark.createDataFrame([(0, [1, 2, 3, 3], [0, 0, 1, 1])], "k int, tokens array<int>, mask array<int>")
    rows = {r["pos"]: r for r in score(df).collect()}
    assert rows[0]["loss"] == pytest.approx(-math.log(4 / 8)) and rows[0]["mask"] == 0
    assert rows[1]["loss"] == pytest.approx(math.log(4)) and rows[1]["mask"] == 1
    assert len(rows) == 3
    large = {r["pos"]: r for r in losses.counting_scorer(counts, 50257, ["k"])(df).collect()}
    assert large[0]["loss"] == pytest.approx(-math.log(4 / (4 + 50257)))


def test_register_benchmark(spark):
    benchmarks.register_benchmark("own", benchmarks.read_completion, choices.completion_items)
    try:
        assert benchmarks.benchmark("own").split == "test"
        with pytest.raises(ValueError):
            benchmarks.benchmark("nope")
    finally:
        del benchmarks._BENCHMARKS["own"]


def test_model_plugin(spark):
    """Any scorer with the same columns fits, for instance one behind mapInPandas."""

    def flat_loss(batches):
        for pdf in batches:
            out = pdf[["bench", "item_id", "cand_idx", "mask"]].explode("mask")
            out["pos"], out["loss"] = 0, out["cand_idx"].astype(float)
            yield out[["bench", "item_id", "cand_idx", "pos", "loss", "mask"]]

    df = spark.createDataFrame(
        [("b", "i", None, "q", ["x", "y"], 0)],
        "bench string, item_id string, subject string, ctx string, candidates array<string>, label int",
    )
    tokens = choices.candidate_tokens(df, BYTES)
    scored = tokens.mapInPandas(
        flat_loss, "bench string, item_id string, cand_idx int, pos int, loss double, mask int"
    )
    predicted = choices.predictions(choices.candidate_scores(scored))
    assert choices.accuracy(predicted, df, ["bench"]).first()["accuracy"] == 1.0
    assert choices.on_rank(spark.range(5), "id", 1, 2).count() == 2
    assert df.select(F.size("candidates")).first()[0] == 2
