"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import plan_copies, plan_quality, plan_sizes, plan_terms

_PLANS = [plan_copies, plan_terms, plan_sizes, plan_quality]
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in _PLANS for k, s in p.ORACLE.items()}
