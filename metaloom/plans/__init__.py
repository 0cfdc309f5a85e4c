"""Registered queries over the given tables, with the SQL that gives the same rows."""

from metaloom.plans import analysis, core, records, search  # noqa: F401
from metaloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
