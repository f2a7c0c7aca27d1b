"""The cap by boundary search gives the rows that testing everything gives."""

import pytest

from tokenloom.operators import filters
from tokenloom.operators.tokenizers import ByteTokenizer

BYTES = ByteTokenizer()
SCHEMA = "ord long, instruction string, context string, response string, source string"
GOOD, SHORT = "an answer that is long enough to be kept by the length test", "no"


def made():
    rows = []
    for i in range(300):
        rows.append((i, "question", "", GOOD, "all"))
        rows.append((i * 3 + 1, "question", "", GOOD if i % 7 == 0 else SHORT, "some"))
        rows.append((i, "question", "", GOOD if i == 299 else SHORT, "last"))
        rows.append((i, None if i % 2 else "question", "", SHORT, "none"))
    return [*rows, (5, "question", "", GOOD, "single")]


@pytest.mark.parametrize("cap", [0, 1, 3, 40, 1000])
def test_boundary_search_equals_cap_over_everything(spark, cap):
    df = spark.createDataFrame(made(), SCHEMA).repartition(4)
    plain = filters.cap_per_source(filters.skip_reasons(df, BYTES), cap)
    found = filters.capped_reasons(df, BYTES, cap=cap)
    order = lambda rows: sorted(map(tuple, rows.select(*plain.columns).collect()), key=str)
    assert order(found) == order(plain)


def test_texts_beyond_the_boundary_are_not_tested(spark, monkeypatch):
    df = spark.createDataFrame(made(), SCHEMA)
    tested = []
    plain = filters.skip_reasons

    def counted(examples, *args, **options):
        tested.append(examples.where("source = 'all'").count())
        return plain(examples, *args, **options)

    monkeypatch.setattr(filters, "skip_reasons", counted)
    filters.capped_reasons(df, BYTES, cap=3).count()
    assert filters.FIRST_ROUND * 3 <= sum(tested) < 2 * filters.FIRST_ROUND * 3


def test_no_rows(spark):
    assert filters.capped_reasons(spark.createDataFrame([], SCHEMA), BYTES, cap=3).count() == 0
