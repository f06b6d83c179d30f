"""All queries of the library's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from . import review_queries, rules, scalars, search, source_queries, state_queries

_MODULES = (search, scalars, state_queries, rules, source_queries, review_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
