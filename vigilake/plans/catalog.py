"""Every registered query and, where SQL can express it, its SQL equivalent."""

from __future__ import annotations

from vigilake.plans import feature_queries, fusion_queries, metric_queries, risk_queries

QUERIES = feature_queries.QUERIES | metric_queries.QUERIES | risk_queries.QUERIES | fusion_queries.QUERIES
ORACLE_SQL = feature_queries.ORACLE_SQL | metric_queries.ORACLE_SQL | risk_queries.ORACLE_SQL | fusion_queries.ORACLE_SQL
