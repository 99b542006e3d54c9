"""Every registered query of the core library, with its SQL twin where one exists."""

from __future__ import annotations

from quire.plans import edit_queries, format_queries, log_queries, parse_queries, structure_queries, text_queries, tree_queries

PARTS = (text_queries, structure_queries, log_queries, format_queries, edit_queries, parse_queries, tree_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
