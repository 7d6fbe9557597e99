"""All queries of this subpackage and the SQL for those that SQL can express."""

import importlib

MODULES = ("looks", "leaks", "packing", "terms", "neardup", "neighbours", "docpairs", "handwritten", "syntax")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    try:
        _module = importlib.import_module(f"lodestrand.llm.{_name}")
    except ModuleNotFoundError as _gone:
        if _gone.name != f"lodestrand.llm.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
