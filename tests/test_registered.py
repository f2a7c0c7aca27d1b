"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from tokenloom.plans import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    verdict, _, _ = compare(spark, duck, sf_dir, name, QUERIES[name], CHECKS.get(name))
    assert verdict.startswith("ok"), verdict


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
    assert QUERIES.items() <= queries().items() and CHECKS.items() <= oracle_sql().items()
