"""Registered queries of the library's operators."""

from __future__ import annotations

from foldspan.plans import design_queries, evidence_queries, record_queries

_PARTS = (evidence_queries, design_queries, record_queries)


def queries() -> dict:
    return {n: q for part in _PARTS for n, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for part in _PARTS for n, q in part.oracle_sql().items()}
