"""Compression distance: held-out accuracy, model edge cases and odd rows."""

import zlib

from tokenloom.llm import toxicity
from tokenloom.llm.queries import QUERIES


def test_query_on_held_out_documents(spark):
    """Larger data than the other tests, since a class of a few dozen teaches little."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    toxic = {r["doc_id"]: r["toxic"] for r in labels}
    got = QUERIES["op10_zstd_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    caught = [r["predicted"] for r in unseen if toxic[r["doc_id"]]]
    wrong = [r["predicted"] for r in unseen if not toxic[r["doc_id"]]]
    assert sum(caught) >= 0.7 * len(caught)
    assert sum(wrong) <= 0.06 * len(wrong)


def test_odd_rows(spark):
    plain = [f"the garden {i} is green and the house {i * 7} stands near it" for i in range(60)]
    bad = [f"you are an idiot and a moron said number {i}" for i in range(60)]
    rows = [(i, t, "en", 0.5) for i, t in enumerate(plain + bad)]
    rows += [(900, None, None, None), (901, "", None, None), (902, "\ud7ff " * 9, "x", 1.0)]
    rows += [(None, bad[0], None, None), (903, "idiot " * 60_000, None, None), (0, plain[0], "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = [(i, int(i >= 60)) for i in range(120)] + [(None, 1), (5, None), (7, 0), (7, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[900]["score"] == by_id[901]["score"]
    assert not by_id[900]["predicted"]
    model = toxicity.train(toxicity.fit_sample(docs, labels))
    scored = toxicity.score(docs, model)
    assert scored.columns == ["tox_score", *docs.columns] and scored.count() == len(rows)


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_near_copies_teach_once():
    copies = [f"same words here in a long enough text marker{i % 2}" for i in range(50)]
    others = [" ".join(f"own{i}x{j}" for j in range(8)) + " badword" for i in range(9)]
    content = toxicity.toxic_content(copies + others, [f"calm text {i}" for i in range(40)])
    assert b" badword " in content and b"marker" not in content
