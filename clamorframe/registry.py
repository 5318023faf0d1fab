"""Queries of the engine's own operators, with the same in DuckDB's SQL."""

from __future__ import annotations

from .plans import built, more, queries, rounds

QUERIES = queries.QUERIES | more.QUERIES | built.QUERIES | rounds.QUERIES
SQL = queries.SQL | more.SQL | built.SQL | rounds.SQL

__all__ = ["QUERIES", "SQL"]
