import importlib.util
import os
import re

import __spark_entry__ as entry
import pytest

D = "/root/testdata/sf0.001"


def test_catalog():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "hybrid_search__R4" in names
    if importlib.util.find_spec("lodestrand.llm"):
        assert {f"p{n}_found" for n in range(1, 11)} <= set(names)


def test_core_never_imports_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "lodestrand")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                assert not re.search(r"(?:from|import)\s+lodestrand\.llm", open(os.path.join(folder, name)).read()), name


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p1_rolling", "traced__G6", "hygiene__A9", "crushed_events__D1", "blended_notes__K3"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, D).count() >= 0
