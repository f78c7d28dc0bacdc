"""All queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from speechloom.llm import conversations_queries, leakage_queries, lookalikes_queries, nearest_queries, packing_queries, readability_queries, turns_queries

_MODULES = [nearest_queries, turns_queries, conversations_queries, lookalikes_queries, packing_queries, leakage_queries, readability_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
