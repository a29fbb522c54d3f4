"""All registered queries with their SQL."""

from __future__ import annotations

from . import book_queries, derived_queries, event_queries, import_queries, store_queries, text_queries

MODULES = (event_queries, book_queries, text_queries, derived_queries, import_queries, store_queries)
QUERIES = {name: make for module in MODULES for name, make in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
