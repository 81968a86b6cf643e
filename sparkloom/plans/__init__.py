"""The registered queries: operators bound to the input tables."""

from __future__ import annotations

from sparkloom.plans import code_queries, detail_queries, framework_queries, graph_queries, render_queries, usage_queries
from sparkloom.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    return QUERIES, ORACLES


#: The modules register their queries when imported.
MODULES = (code_queries, detail_queries, framework_queries, graph_queries, render_queries, usage_queries)

flagship = graph_queries.module_coupling
