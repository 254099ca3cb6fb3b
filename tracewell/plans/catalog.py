"""All registered queries of the call log, with their DuckDB SQL."""

from __future__ import annotations

from . import detect_queries, flow_queries, log_queries, policy_queries, text_queries

MODULES = (log_queries, policy_queries, detect_queries, flow_queries, text_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
