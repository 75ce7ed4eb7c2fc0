"""All queries of the core with their SQL."""

from __future__ import annotations

from pairloom.operators import training_queries
from pairloom.plans import audit_queries, evidence_queries, judge_queries, metric_queries, pack_queries, probe_queries, ranking_queries, registry, rowlevel_queries, solver_queries  # noqa: F401  (registers its queries)

QUERIES = {**registry.QUERIES, **training_queries.QUERIES}
SQL = {**registry.SQL, **training_queries.SQL}
