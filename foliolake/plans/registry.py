"""The engine's queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import page_queries, review_queries, script_queries, table_queries, text_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **review_queries.QUERIES, **page_queries.QUERIES, **script_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **table_queries.ORACLES, **review_queries.ORACLES, **page_queries.ORACLES, **script_queries.ORACLES}
