"""All queries of the package and their DuckDB twins, gathered from the plan modules."""

from __future__ import annotations

from quillmill.plans import catalog_queries, motion_queries, russian_queries, series_queries, text_queries, timeline_queries, word_queries

_MODULES = (text_queries, russian_queries, series_queries, catalog_queries, word_queries, motion_queries, timeline_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
#: The whole linter over the documents, in the SQL that the Russian rows have.
ORACLE_SQL["doc_lint_full"] = russian_queries.full_lint("documents", 2000, 50, "")
