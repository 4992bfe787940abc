"""All queries of the log operators over the given tables, and their SQL oracles."""

from __future__ import annotations

from logweave.plans import catalog_queries, feature_queries, log_queries, output_queries

_MODULES = (log_queries, feature_queries, catalog_queries, output_queries)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
