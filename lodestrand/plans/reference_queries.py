"""All queries over the reference's operators, with their SQL."""

import importlib

MODULES = ("index_queries", "analytics_queries", "retrieval_queries", "graph_queries", "streaming_queries")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _registry = importlib.import_module(f"lodestrand.plans.{_name}").R
    QUERIES |= _registry.queries
    SQL |= _registry.sql
