import pytest

from lodestrand import tools

D = "/root/testdata/sf0.001"
ARGUMENTS = {
    "project": 1, "file_id": 5, "symbol_id": 20, "query": "how does the cache throttle work", "pattern": r"return \w+", "kind": "method", "concept": "export", "name": "DenseCommit",
}


@pytest.mark.parametrize("name", sorted(tools.TOOLS))
def test_every_tool_runs(spark, name):
    wanted = tools.TOOLS[name].__code__.co_varnames[1 : tools.TOOLS[name].__code__.co_argcount]
    required = len(wanted) - len(tools.TOOLS[name].__defaults__ or ())
    got = tools.call(spark, D, name, **{k: ARGUMENTS[k] for k in wanted[:required]})
    assert got.columns and got.count() >= 0


def test_surfaces(spark):
    assert set(tools.CORE) <= set(tools.TOOLS) and len(tools.CORE) == 13 and len(tools.TOOLS) >= 26
    with pytest.raises(ValueError):
        tools.call(spark, D, "pack_context", "core", query="x", project=1)


def test_search_honours_its_mode(spark):
    from lodestrand.plans.registry import Tables

    vectors = Tables(spark, D).vectors.where("size(embedding) = 64 and type = 'file'").orderBy("vid").limit(1).collect()[0]
    own = lambda text: [float(x) for x in vectors.embedding]
    found = {m: [r.candidate for r in tools.call(spark, D, "search", query="how does the cache throttle work", mode=m, limit=8, embed=own).collect()] for m in ("fts", "vector")}
    assert found["vector"][0] == f"file:{vectors.ref_id}" and found["vector"][0] not in found["fts"] and len(found["vector"]) == 8
    hybrid = {r.candidate for r in tools.call(spark, D, "search", query="how does the cache throttle work", mode="hybrid", limit=60, embed=own).collect()}
    assert hybrid & set(found["fts"]) and hybrid & set(found["vector"])
    said = []
    with_answer = tools.call(spark, D, "search", query="x", mode="vector", limit=8, embed=lambda t: said.append(t) or own(t), imagine=lambda q: "```py\nan answer\n```")
    assert with_answer.count() == 8 and "an answer" in said
    with pytest.raises(ValueError):
        tools.call(spark, D, "search", query="x", mode="other")
