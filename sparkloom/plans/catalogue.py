"""The query catalogue: each reference operator applied to the driver tables, with its oracle SQL."""

from sparkloom.plans import architecture, graphs, histories, index_queries, logs, lookups, report_queries, reporting, rule_queries, session_queries, similar_and_streams, source_queries, store_queries  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES  # noqa: F401
