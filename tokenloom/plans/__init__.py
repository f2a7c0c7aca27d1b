"""Registered queries and the SQL each of them is checked against."""

from tokenloom.plans import mix, packing, runs, scoring  # noqa: F401
from tokenloom.plans.catalog import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
