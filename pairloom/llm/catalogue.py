"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from pairloom.llm import annotators, contamination, leximin, percentiles, ranking, tokens, topics

_MODULES = [ranking, percentiles, leximin, annotators, tokens, contamination, topics]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
