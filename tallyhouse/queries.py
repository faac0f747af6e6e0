"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tallyhouse.plans import catalog


def queries() -> dict:
    return {name: q.run for name, q in catalog.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in catalog.QUERIES.items() if q.sql}
