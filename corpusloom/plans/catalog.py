"""Registry of the library's queries and their DuckDB counterparts."""

from __future__ import annotations

from corpusloom.plans import code_plans, context_plans, diagnostic_plans, graph_plans, search_plans, text_plans

_PLANS = (text_plans, search_plans, graph_plans, context_plans, code_plans, diagnostic_plans)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _p in _PLANS:
    QUERIES.update(_p.QUERIES)
    ORACLE_SQL.update(_p.ORACLE_SQL)
