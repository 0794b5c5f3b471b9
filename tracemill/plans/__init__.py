"""All registered queries and their DuckDB twins."""

from tracemill.plans import columns, layouts, links, logs, sessions, streams
from tracemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "columns", "layouts", "links", "logs", "sessions", "streams"]
