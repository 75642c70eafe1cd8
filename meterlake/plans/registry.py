"""All registered queries and their SQL."""

from __future__ import annotations

from . import limit_queries, log_queries, report_queries, state_queries, stream_queries, usage_queries  # noqa: F401
from .adapter import ORACLES, REGISTRY

QUERIES = REGISTRY
ORACLE_SQL = ORACLES
