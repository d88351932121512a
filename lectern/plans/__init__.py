"""Registered queries over the supplied tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from lectern.plans import book_queries, event_queries, table_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **event_queries.QUERIES, **book_queries.QUERIES, **table_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **event_queries.ORACLES, **book_queries.ORACLES, **table_queries.ORACLES}
