"""All queries of the core library and their SQL."""

from __future__ import annotations

from speechloom.plans import corpus_queries, file_queries, interval_queries, periods_queries, rule_queries, sequence_sql

_MODULES = [periods_queries, sequence_sql, interval_queries, corpus_queries, file_queries, rule_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
