"""Encoding, masks, split, shards, analysis and reports."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.operators import analysis, encode, filters, langid, lookup, quality, split, windows
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.sources import reports, shards

BYTES = ByteTokenizer()
SCHEMA = "ord bigint, instruction string, context string, response string, source string"


def encoded(spark, rows):
    df = spark.createDataFrame([(i, *r, "s") for i, r in enumerate(rows)], SCHEMA)
    return encode.encode_examples(encode.with_token_counts(df, BYTES), BYTES)


def test_known_row(spark):
    row = spark.createDataFrame(
        [([1, 2, 3, 4, 5, 256], [0, 0, 1, 1, 1, 1])], "tokens array<int>, mask array<tinyint>"
    )
    padded = encode.pad(row, 256, 8)
    r = windows.masked_rows(encode.token_counts(padded, 256)).first()
    assert r["tokens"] == [1, 2, 3, 4, 5, 256, 256, 256]
    assert r["mask"] == [0, 0, 1, 1, 1, 1, 0, 0]
    assert (r["total_tokens"], r["prompt_tokens"], r["response_tokens"]) == (5, 2, 4)
    assert r["x"] == [1, 2, 3, 4, 5, 256, 256]
    assert r["y"] == [2, 3, 4, 5, 256, 256, 256]
    assert r["loss_mask"] == [0, 1, 1, 1, 1, 0, 0]


def test_counts_of_odd_rows(spark):
    rows = [([256, 256], [0, 0]), ([1, 256, 2, 256], [0, 1, 1, 1])]
    df = spark.createDataFrame(rows, "tokens array<int>, mask array<tinyint>")
    got = encode.token_counts(df, 256).collect()
    assert [(r["total_tokens"], r["prompt_tokens"], r["response_tokens"]) for r in got] == [
        (0, 2, 0),
        (3, 1, 3),
    ]


words = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(words, words, words), min_size=1, max_size=12))
def test_encode_then_read_back(spark, rows):
    padded = encode.pad(encoded(spark, rows), 256, 400)
    counted = encode.token_counts(padded, 256)
    for r in encode.parsed_fields(encode.decoded_text(counted, BYTES)).collect():
        assert len(r["tokens"]) == len(r["mask"]) == 400
        assert r["total_tokens"] == r["prompt_tokens"] + r["response_tokens"] - 1
        i, c, a = (x.strip() for x in rows[r["ord"]])
        if "###" not in i + c + a:
            assert (r["full_text"].endswith(a)) and r["instruction"] == i and r["input"] == c
            assert r["response"] == a


@pytest.mark.parametrize(
    "text, want",
    [
        (" plain ", ("plain", "", "")),
        ("### Instruction:\ni\n\n### Response:\na", ("i", "", "a")),
        ("### Instruction:\ni\n\n### Input:\nc\n\n### Response:\na", ("i", "c", "a")),
        ("### Instruction:\ni\n\n### Response:\na ### Response:\nb", ("i", "", "a ### Response:\nb")),
        ("### Instruction:\nno end", ("### Instruction:\nno end", "", "")),
        ("### Instruction:\n### Response:\n", ("", "", "")),
        ("### Instruction:\ni### Response:x", ("i", "", "")),
    ],
)
def test_parse(spark, text, want):
    df = spark.createDataFrame([(text,)], "full_text string")
    r = encode.parsed_fields(df).first()
    assert (r["instruction"], r["input"], r["response"]) == want


def test_cut_at_the_answer(spark):
    df = spark.createDataFrame([("a### Response:\nb",), ("none",)], "full_text string")
    got = [(r["prompt_text"], r["response_text"]) for r in encode.prompt_and_response(df).collect()]
    assert got == [("a### Response:\n", "b"), ("none", "")]


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (39, 1), (40, 2)])
def test_holdout_size(spark, n, want):
    df = spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("ord"))
    got = split.holdout_split(df, ["source", "ord"])
    assert got.where("split = 'val'").count() == want
    assert got.count() == n


def test_row_shards(spark):
    df = spark.range(2049).select(F.lit("train").alias("split"), F.col("id").alias("ord"))
    rows = split.row_shards(df, ["ord"]).collect()
    sizes = [sum(r["shard_id"] == s for r in rows) for s in (0, 1)]
    assert sizes == [2048, 1] and len({(r["shard_id"], r["row_id"]) for r in rows}) == 2049


def test_stored_examples(spark, tmp_path):
    rows = [("question", "", "answer " * 5)] * 5
    df = spark.createDataFrame([(i, *r, "s" * 40) for i, r in enumerate(rows)], SCHEMA)
    counted = encode.with_token_counts(df, BYTES)
    keys = ["source", "ord"]
    placed = counted.join(split.row_shards(split.holdout_split(counted.select(*keys), keys), keys, rows_per_shard=2), keys)
    path = str(tmp_path / "examples")
    shards.write_example_shards(placed, BYTES, path)
    stored = shards.read_example_shards(spark, path)
    assert stored.count() == 5 and {len(r["source"]) for r in stored.collect()} == {40}
    assert quality.shard_gaps(stored).count() == 0
    broken = stored.where("NOT (split = 'train' AND shard_id = 0)")
    assert quality.shard_gaps(broken).count() == 1
    assert {r["split"] for r in quality.shards_before_gap(broken).collect()} == {"val"}
    padded = encode.pad(stored, 256)
    table = analysis.analysis_table(padded, BYTES, 2)
    assert table.columns == [
        "index", "source", "instruction", "input", "response",
        "total_tokens", "prompt_tokens", "response_tokens",
    ]
    csv = str(tmp_path / "csv")
    reports.write_analysis_csv(table, csv)
    assert reports.read_analysis_csv(spark, csv).count() == 5
    lines = reports.preview_lines(table)
    out = str(tmp_path / "preview")
    reports.write_preview(lines, out)
    text = spark.read.text(out)
    assert text.count() >= 3
    assert reports.read_metadata(spark, str(tmp_path / "absent")) is None


def test_prefix_limit_and_unknown_source(spark):
    df = spark.createDataFrame([(0, i, None) for i in range(5)], "shard_id int, row_id int, source string")
    assert [r["row_id"] for r in analysis.shard_prefix(df, 2).collect()] == [0, 1]
    assert analysis.shard_prefix(df, 0).count() == 5


def test_single_source_has_no_count_table(spark):
    df = spark.createDataFrame([("a",), ("a",)], "source string")
    assert analysis.source_counts(df).count() == 0


def test_sample_drops_rows_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).cast("string").alias("source"))
    sample = analysis.sample_per_source(df, "id", 3)
    assert sample.count() == 6
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()


def test_language_job(spark):
    english, french = "the cat and the dog are in the house", "le chat et le chien sont dans la maison"
    train = spark.createDataFrame([("en", english), ("fr", french)], "lang string, text string")
    profile = langid.train_profile(train)
    asked = spark.createDataFrame(
        [(0, "the dog and the house"), (1, "la maison et le chat"), (2, "no"), (3, None)], "k int, text string"
    )
    want = {0: "en", 1: "fr", 2: None, 3: None}
    got = langid.identify(asked, profile, keys=["k"])
    assert {r["k"]: r["language"] for r in got.collect()} == want
    # The same answer when the weights are too many to broadcast.
    salted = lookup.lookup_join(
        asked.select("k", F.explode(langid.trigrams(F.col("text"))).alias("tri")),
        profile.weights, ["tri"], spread_by=F.col("k"), max_cells=3, salts=4,
    )
    plain = lookup.lookup_join(
        asked.select("k", F.explode(langid.trigrams(F.col("text"))).alias("tri")),
        profile.weights, ["tri"], spread_by=F.col("k"),
    )
    assert sorted(map(tuple, salted.select(*plain.columns).fillna(0).collect())) == sorted(
        map(tuple, plain.fillna(0).collect())
    )
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()


def test_language_stage_rejects(spark):
    english = "the cat and the dog are in the house and the garden"
    french = "le chat et le chien sont dans la maison et le jardin"
    train = spark.createDataFrame([("en", english), ("fr", french)], "lang string, text string")
    df = spark.createDataFrame(
        [(0, "the dog", "", english, "s"), (1, "le chien", "", french, "s"), (2, None, None, None, "s")], SCHEMA
    )
    got = filters.skip_reasons(df, BYTES, profile=langid.train_profile(train))
    assert {r["ord"]: r["skip_reason"] for r in got.collect()} == {0: None, 1: "lang", 2: "fmt"}


def test_metadata_and_preview(spark, tmp_path):
    rows = [("s", i, None if i % 2 else "lang") for i in range(4)] + [("t", 0, None)]
    reasons = spark.createDataFrame(rows, "source string, ord bigint, skip_reason string")
    kept = reasons.where("skip_reason IS NULL").select("source", "ord")
    placed = split.row_shards(split.holdout_split(kept, ["source", "ord"]), ["source", "ord"])
    path = str(tmp_path / "meta")
    reports.write_metadata(reports.mix_metadata(filters.skip_stats(reasons), placed, 1.26), path)
    stored = reports.read_metadata(spark, path)
    r = stored.first()
    assert r["datasets_used"] == ["s", "t"] and r["total_elapsed_s"] == 1.3
    assert r["per_dataset_stats"]["s"]["kept"] == 2
    assert (r["train"]["examples"], r["val"]["examples"], r["val"]["shards"]) == (2, 1, 1)
    table = spark.createDataFrame(
        [(0, "s", "i", "c", "r", 3, 1, 3), (1, "t", "i2", "", "r2", 5, 2, 4)],
        "index bigint, source string, instruction string, input string, response string, "
        "total_tokens int, prompt_tokens int, response_tokens int",
    )
    lines = reports.preview_lines(table, 1, stored).collect()
    assert sorted({x["section"] for x in lines}) == [1, 2, 3, 4]
    sample = [x["line"] for x in lines if x["section"] == 4 and x["part"].startswith("s")][0]
    assert sample == (
        "[s]  #0  total=3 tok  (prompt=1 | response=3)\nINSTRUCTION:\ni\n\nINPUT:\nc\n\nRESPONSE:\nr"
    )


def test_chain_with_a_python_tokenizer(spark, tmp_path):
    import base64

    from tokenloom.operators.tokenizers import RankFileTokenizer

    ranks = tmp_path / "r.txt"
    ranks.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    bpe = RankFileTokenizer(spark, str(ranks))
    text = "the cat and the dog are in the house and the garden"
    df = spark.createDataFrame([(0, "the dog", "", text, "s"), (1, "Ж", "", text, "s")], SCHEMA)
    profile = langid.train_profile(spark.createDataFrame([("en", text)], "lang string, text string"))
    reasons = filters.skip_reasons(df, bpe, profile=profile)
    assert {r["ord"]: r["skip_reason"] for r in reasons.collect()} == {0: None, 1: "lang"}
    kept = filters.kept_examples(df, bpe, kept_keys=reasons.where("skip_reason IS NULL"))
    one = encode.encode_examples(kept, bpe).first()
    same = encode.encode_examples(filters.kept_examples(df, BYTES), BYTES).first()
    assert one["tokens"] == same["tokens"] and one["mask"] == same["mask"]


def test_misaligned_rows(spark):
    keys = "split string, shard_id int, row_id int"
    tokens = spark.createDataFrame(
        [("train", 0, i, [1] * n) for i, n in enumerate([3, 3, 2, 3])], f"{keys}, tokens array<int>"
    )
    masks = spark.createDataFrame(
        [("train", 0, 0, [1] * 3), ("train", 0, 1, [1] * 2), ("train", 0, 2, [1] * 2), ("train", 0, 9, [1] * 3)],
        f"{keys}, mask array<tinyint>",
    )
    found = quality.misaligned_rows(tokens, masks, 3).collect()
    assert sorted(r["row_id"] for r in found) == [1, 2, 3, 9]
