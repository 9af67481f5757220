"""Registry of the engine's own queries and the SQL that each must equal."""

from __future__ import annotations

from larkspur import queries, scalar_queries, stream_queries  # noqa: F401  (scalar_queries adds to queries)

QUERIES = queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | stream_queries.ORACLE_SQL
