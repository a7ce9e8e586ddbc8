"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import cards_plans, context_plans, evidence_plans, function_plans, graph_plans, matching_plans, queue_plans, source_plans, stream_plans, template_plans, text_plans, upkeep_plans
from .fixtures import Query, oracle, query

PARTS = (function_plans, graph_plans, queue_plans, matching_plans, text_plans, evidence_plans, cards_plans, source_plans, stream_plans, upkeep_plans, template_plans, context_plans)

QUERIES: dict[str, Query] = {name: query(f) for part in PARTS for name, (f, _) in part.PLANS.items()}
ORACLE_SQL: dict[str, str] = {name: oracle(sql) for part in PARTS for name, (_, sql) in part.PLANS.items() if sql}
