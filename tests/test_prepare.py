"""The whole preparation as one job, its metadata and report, and the two-way split of a stream."""

from tokenloom.operators import pack
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.sources import prepare

BYTES = ByteTokenizer()
SCHEMA = "ord bigint, source string, instruction string, context string, response string"


def _examples(spark, n=30):
    rows = [
        (i, s, f"Please answer question {i} of {s}", "given" if i % 2 else "", "the answer is here " * 2)
        for s in ("a", "b")
        for i in range(n)
    ]
    rows[3] = (3, "a", None, None, None)  # not convertible
    rows[4] = (4, "a", "Too short", "", "x")
    return spark.createDataFrame(rows, SCHEMA)


def test_prepared_folder(spark, tmp_path):
    path = str(tmp_path / "mix")
    metadata = prepare.prepare_mix(
        _examples(spark), BYTES, path, cap=10, rows_per_shard=4, fraction=0.25, seed=5, max_tokens=400
    )
    m = metadata.first()
    # The cap ends source a at its tenth kept row; what lies behind is not counted.
    stats = {s: tuple(c) for s, c in m["per_dataset_stats"].items()}
    assert stats["a"][0] == stats["b"][0] == 10 and sum(stats["a"]) == 12 and sum(stats["b"]) == 10
    assert (m["seed"], m["shard_size"], m["val_size"], m["sequence_length"]) == (5, 4, 0.25, 400)
    assert (m["train"]["examples"], m["val"]["examples"]) == (15, 5)
    assert (m["train"]["shards"], m["val"]["shards"]) == (4, 2)
    stored = prepare.prepared_examples(spark, path).collect()
    assert len(stored) == 20 and max(r["row_id"] for r in stored) == 3
    places = {(r["split"], r["shard_id"], r["row_id"]) for r in stored}
    assert len(places) == 20
    assert all(sum(r["mask"]) == r["n_tokens"] - r["prompt_len"] for r in stored)


def test_report_of_each_split(spark, tmp_path):
    path = str(tmp_path / "mix")
    prepare.prepare_mix(_examples(spark), BYTES, path, cap=0, rows_per_shard=8, fraction=0.5)
    lines = prepare.prepared_report(spark, BYTES, path, n_per_source=1).collect()
    values = [r["line"] for r in sorted(lines, key=lambda r: r["part"]) if r["section"] == 0]
    assert values[2] == "Shard size       : 8"
    assert values[4].startswith("Train examples   : 29  (4 shards)")
    assert len([r for r in lines if r["section"] == 1]) == 2
    for split in ("train", "val"):
        own = [r for r in lines if r["split"] == split]
        assert [sum(r["section"] == s for r in own) for s in (2, 3, 4)] == [3, 2, 2]
    assert any("INPUT:\ngiven" in r["line"] or "question" in r["line"] for r in lines if r["section"] == 4)


def test_mix_without_kept_rows(spark, tmp_path):
    path = str(tmp_path / "mix")
    none = _examples(spark).where("instruction IS NULL")
    m = prepare.prepare_mix(none, BYTES, path, cap=3).first()
    assert m["per_dataset_stats"]["a"]["skipped_format"] == 1
    assert (m["train"]["examples"], m["val"]["examples"]) == (0, 0)


def test_two_way_split_is_the_stream_cut_once(spark):
    texts = ["", "ab", "a longer text of some bytes", "x" * 40, "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stream = [t for text in texts for t in (256, *text.encode())]
    for share in (0.0, 0.5, 0.9, 1.0):
        rows = pack.two_way_split(pack.place_documents(docs, BYTES), BYTES, share).collect()
        cut = int(len(stream) * share)
        for split, want in (("train", stream[:cut]), ("val", stream[cut:])):
            own = sorted((r["shard_pos"], r["tokens"]) for r in rows if r["split"] == split)
            assert [t for _, tokens in own for t in tokens] == want
            assert all(p == sum(len(t) for _, t in own[:i]) for i, (p, _) in enumerate(own))
