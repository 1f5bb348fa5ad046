"""Name -> query and name -> oracle SQL of everything outside the llm subpackage."""

from __future__ import annotations

from leafloom.plans import stream_queries, table_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **table_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **table_queries.ORACLES, **stream_queries.ORACLES}
