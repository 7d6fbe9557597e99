"""Hand-computed expectations of fusion, scores, selection and planning."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import paths, scores, texts, vectors
from lodestrand.operators import fusion, planner, search
from lodestrand.operators.cache import LruCache
from lodestrand.operators.pipeline import CachedHydrator, CandidatePipeline, DedupFilter, FixedSource, JoinHydrator, ScoreColumn, TopKSelector, WhereFilter


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def lists(spark, *streams):
    rows = [(n, r + 1, c) for n, stream in enumerate(streams) for r, c in enumerate(stream)]
    return spark.createDataFrame(rows, "source_ord int, rank int, candidate string")


@pytest.mark.parametrize("streams,want", [
    (("abc", "cad"), [("a", 0.032522), ("c", 0.032266), ("b", 0.016129), ("d", 0.015873)]),
    (("aab", "b"), [("a", 0.032522), ("b", 0.032266)]),
])
def test_rrf(spark, streams, want):
    got = [(r.candidate, round(r.score, 6)) for r in fusion.rrf(lists(spark, *streams)).orderBy("rank").collect()]
    assert got == want


def test_rrf_ignores_stream_order(spark):
    a, b, c = "abcde", "ecafg", "gxa"
    one = {(r.candidate, round(r.score, 12)) for r in fusion.rrf(lists(spark, a, b, c)).collect()}
    assert one == {(r.candidate, round(r.score, 12)) for r in fusion.rrf(lists(spark, c, a, b)).collect()}


def test_scores(spark):
    assert [value(spark, scores.rank_score(F.lit(r))) for r in (1, 2, 3, 4, 8, 10)] == [1, 0.5, 0.387, 0.333, 0.25, 0.231]
    assert [round(value(spark, vectors.distance_score(F.lit(d))), 6) for d in (0.0, 1.0, math.sqrt(2))] == [1, 0.5, 0.414214]
    assert [round(value(spark, scores.recency(F.lit(a), 1000)), 6) for a in (0, 1000, 2500, -5)] == [1, 0.5, 0.176777, 1]
    assert [round(value(spark, scores.frequency(F.lit(c))), 6) for c in (0, 1, 3, 5, 9)] == [0, 0.2, 0.6, 1, 1]
    pair = lambda a, b: scores.weighted_sum([(F.lit(a), 2.0), (F.lit(b), -1.0)])
    assert round(value(spark, scores.weighted_sum([(F.lit(0.5), 2.0), (F.lit(1.0), -0.5)])), 6) == 1.5
    assert round(value(spark, scores.weighted_sum([(F.lit(0.1), 1.0), (F.lit(1.0), -2.0)])), 6) == 0.033333
    assert value(spark, scores.weighted_sum([])) == 1 and value(spark, pair(float("nan"), 0.0)) == 1
    assert round(value(spark, scores.recent_file(F.lit(1.0), F.lit(0.5), F.lit(True))), 6) == 0.8
    assert round(value(spark, scores.recent_file(F.lit(0.5), F.lit(0.0), F.lit(False))), 6) == 0.2
    assert [round(value(spark, vectors.hamming_cosine(F.lit(d))), 6) for d in (0, 8, 16, 32)] == [1, 0.707107, 0, -1]


def test_bands():
    assert [(0xABCDEF12 >> s) & 4095 for s in (0, 12)] == [3858, 3294]
    draws = vectors.uniform(1)
    assert all(0 <= next(draws) < 1 for _ in range(1000))
    assert all(abs(sum(x * x for x in p) - 1) < 1e-6 for p in vectors.hyperplanes(16, 4))


def test_equal_vectors_share_buckets(spark):
    df = spark.createDataFrame([(1, [0.1, -0.4, 2.0]), (2, [0.2, -0.8, 4.0]), (3, [-0.1, 0.4, -2.0])], "id int, v array<float>")
    planes = vectors.hyperplanes(3)
    got = {r.id: (r.s, tuple(r.b)) for r in df.select("id", vectors.simhash(F.col("v"), planes).alias("s")).select("id", "s", vectors.buckets(F.col("s")).alias("b")).collect()}
    assert got[1] == got[2] and got[3][0] == (~got[1][0] & 0xFFFFFFFF)
    assert all(1 <= b <= 4095 for _, bs in got.values() for b in bs)


def test_vector_edges(spark):
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert value(spark, vectors.cosine(a(1, 0), a(0, 0))) == 0 and value(spark, vectors.cosine(a(1, 0), a(1))) == 0
    assert value(spark, vectors.normalised(a(0, 0))) == [0, 0] and value(spark, vectors.normalised(a(3, 4))) == [0.6, 0.8]
    with pytest.raises(Exception):
        value(spark, vectors.dot(a(1, 0), a(1)))


def greedy(rows, k, att):
    left, picked, out = list(rows), {}, []
    while left and len(out) < k:
        best = max(left, key=lambda r: (r[2] * att ** picked.get(r[1], 0), -r[3]))
        left.remove(best)
        out.append((best[0], round(best[2] * att ** picked.get(best[1], 0), 9)))
        picked[best[1]] = picked.get(best[1], 0) + 1
    return out


def test_diversity(spark):
    rows = [("a", "g1", 1.0, 0), ("b", "g1", 0.9, 1), ("c", "g2", 0.6, 2), ("d", "g1", 0.8, 3), ("e", "g2", 0.5, 4)]
    frame = lambda rs: spark.createDataFrame([(1, *r) for r in rs], "q int, id string, g string, s double, o int")
    run = lambda rs, k, att: [(r.id, round(r.effective, 9)) for r in fusion.diverse(frame(rs), "q", "g", "s", "o", k, att).orderBy("slot").collect()]
    assert run(rows, 4, 0.5) == [("a", 1.0), ("c", 0.6), ("b", 0.45), ("e", 0.25)]
    draw = random.Random(5)
    for att in (0.3, 0.9):
        some = [(str(n), draw.choice("xyz"), round(draw.random(), 3), n) for n in range(25)]
        assert run(some, 10, att) == greedy(some, 10, att)
    with pytest.raises(Exception):
        run([("a", "g", -1.0, 0)], 1, 0.5)


def test_blender(spark):
    frame = spark.createDataFrame([(1, 0, "A", p, f"a{p}") for p in (1, 2, 3)] + [(1, 1, "B", p, f"b{p}") for p in (1, 2)], "q int, track_ord int, track string, pos int, candidate string")
    run = lambda df, **k: [r.candidate for r in fusion.blended(df, "q", 5, **k).orderBy("slot").collect()]
    assert run(frame) == ["a1", "b1", "a2", "b2", "a3"]
    assert run(frame.where("candidate <> 'b2'"), spacing={"A": 3}) == ["a1", "b1"]
    assert run(frame, caps={"A": 1}) == ["a1", "b1", "b2"]


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 4), (1, 2, 9), (1, 3, 1)], "g int, o int, n int")
    assert [r.o for r in fusion.within_budget(df, "n", ["g"], ["o"], 12).collect()] == [1]


def test_text_functions(spark):
    w = lambda t, *a: value(spark, texts.windows(F.lit(t), *a))
    assert w("abcdefghij", 4, 1, 10) == ["abcd", "defg", "ghij", "j"] and w("abcdefghij", 4, 9, 3) == ["abcd", "bcde", "cdef"] and w("ab", 4) == ["ab"] and w("", 4) == [""]
    assert [texts.output_cap(x, 6000, 1_000_000) for x in ("economic", "medium", "high", "extra", "max", "ultra")] == [6000, 12000, 24000, 36000, 1_000_000, 4_000_000]
    assert search.grep_tokens(r"foo_bar\w+Baz", False) == ["foo", "bar", "baz"] and search.grep_tokens("a_b", True) == []
    assert value(spark, texts.line_count(F.lit(""))) == 1 and value(spark, texts.estimated_tokens(F.lit("abcde"))) == 2
    assert texts.snapped(17, [11, 17, 21]) == 17 and texts.snapped(8, [11, 17]) == 11
    assert value(spark, texts.scrubbed(F.lit("token=abc /home/me/x"))) == "token=*** /home/***/x"


@pytest.mark.parametrize("query,mode,reason", [
    ("", "fts", "empty query"), ("parseIdParam", "fts", "identifier-shaped query"), ("a.b.c", "fts", "identifier-shaped query"), ("Foo::bar", "fts", "identifier-shaped query"), ("how does capping work", "hybrid", "question phrasing"),
    ("output capping", "fts", "short code-shaped tokens"), ("list of the users in db table", "hybrid", "natural-language query"), ("one two three four five", "fts", "short mixed query")])
def test_planner(query, mode, reason):
    assert planner.plan(query) == (mode, reason)


@pytest.mark.parametrize("path,tier", [("dist/a.js", "excluded"), ("a/yarn.lock", "excluded"), ("src/a.min.js", "excluded"), ("x/vendor/a.go", "excluded"), ("src/a.test.ts", "on_demand"), ("docs/a.md", "on_demand"), ("src/api/a.ts", "core"), ("src/main.ts", "core"), ("lib/a.py", "support"), ("build_tools/a.py", "support")])
def test_tiers(spark, path, tier):
    assert value(spark, paths.index_tier(F.lit(path), F.lit(10))) == tier


def test_path_rules(spark):
    v = lambda c: value(spark, c)
    assert v(paths.index_tier(F.lit("lib/a.py"), F.lit(2_000_000))) == "excluded" and v(paths.promoted(F.lit("support"), F.lit(4))) == "core" and v(paths.promoted(F.lit("support"), F.lit(3))) == "support"
    assert [v(paths.language_id(F.lit(p))) for p in ("a.MTS", "Dockerfile", "x/y", "b.kt")] == ["typescript", "dockerfile", "plaintext", "kotlin"]
    assert v(paths.file_role(F.lit("x/user.service.ts"))) == "service" and v(paths.file_role(F.lit("x/Button.tsx"))) == "React component" and v(paths.file_role(F.lit("x/a.py"))) is None
    assert v(paths.layer(F.lit("db/a.py"), F.lit("unknown"))) == "data" and v(paths.layer(F.lit("db/a.py"), F.lit("test"))) == "test" and v(paths.entry_name(F.lit("cmd/x/main.go")))
    for path, out in (("a/dist/b", True), ("src/x.min.js", True), ("keep.js", False), ("log/deep/a.txt", True), ("log/deep/keep.txt", False)):
        assert v(paths.ignored(F.lit(path), ["# c", "", "dist/", "*.min.js", "log/**", "!log/deep/keep.txt"])) == out


def test_search(spark):
    docs = spark.createDataFrame([(1, "cache layer cache", 1), (2, "layer only", 1), (3, None, 1), (4, "Cache layer", 2), (5, "", 1)], "id int, text string, project int")
    assert [r.id for r in search.bm25(docs, "id", F.col("text"), "cache AND layer").orderBy("rank").collect()] == [1, 4]
    assert {r.id for r in search.bm25(docs, "id", F.col("text"), "cache nothing").collect()} == {1, 4}
    assert {r.id for r in search.bm25(docs, "id", F.col("text"), "layer", keep=F.col("project") == 1).collect()} == {1, 2}
    assert search.bm25(docs, "id", F.col("text"), "AND").count() == 0 and search.bm25(docs.limit(0), "id", F.col("text"), "cache").count() == 0
    assert [r.line_no for r in search.grep(spark.createDataFrame([(1, "a(\nb\n a(")], "id int, t string"), "id", "t", "a(").collect()] == [1, 3]


def test_pipeline(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id int, s double")
    b = spark.createDataFrame([(2, 0.1), (3, 0.7)], "id int, s double")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")

    class Broken:
        name = "broken"

        def candidates(self):
            raise RuntimeError("down")

    class Off:
        name = "off"

        def enable(self):
            return False

        def score(self, c):
            raise AssertionError

    p = CandidatePipeline(
        sources=[FixedSource("a", a), Broken(), FixedSource("b", b)], hydrators=[JoinHydrator("names", names, "id"), CachedHydrator("twice", a.select("id", (F.col("s") * 2).alias("d")), "id", lambda miss: miss.withColumn("d", F.lit(0.0)))],
        filters=[WhereFilter("named", F.col("name").isNotNull()), DedupFilter("id", best="s")], scorers=[ScoreColumn("score", F.col("s") + 1), Off(), ScoreColumn("bad", F.col("nowhere"))], selector=TopKSelector("score", "id", 5))
    out = p.execute()
    assert [(r.id, r.name, r.d) for r in out.selected.orderBy("id").collect()] == [(1, "one", 1.0), (2, "two", 1.8)]
    assert [f[0] for f in out.failed] == ["broken", "score"] and {r.id for r in out.removed[0][1].collect()} == {3}
    assert {e["stage"] for e in p.telemetry.events} >= {"a", "b", "names", "named", "dedup", "top-k"}
    assert fusion.top_k(a, "s", "id", float("inf")).count() == 2 and fusion.top_k(a, "s", "id", -3).count() == 0


def test_cache_and_hypothetical_answers():
    now = [0.0]
    cache = LruCache(2, ttl=10, clock=lambda: now[0])
    cache.set("a", 1)
    cache.set("b", 2)
    assert cache.get("a") == 1
    cache.set("c", 3)
    assert cache.get("b") is None and len(cache) == 2 and cache.get_or_compute("a", lambda: 9) == 1
    now[0] = 11
    assert cache.get("a") is None and cache.get_or_compute("a", lambda: 9) == 9 and cache.delete("c") and not cache.delete("c")
    assert planner.hypothetical("q") is None and planner.hypothetical("q", lambda q: "```py\nx = 1\n```") == "x = 1" and planner.hypothetical("q", lambda q: 1 / 0) is None
    assert planner.variants("how does output capping work?") == ["how does output capping work?", "implementation of output capping work", "function class output capping work"] and planner.variants("x") == ["x", "x implementation"]


def test_reranker_reads_whole_texts(spark, tmp_path):
    from lodestrand.plans.retrieval_queries import R

    texts_ = [(1, "throttle " + "filler " * 200 + "queue planner"), (2, "throttle queue " + "filler " * 200), (3, "nothing")]
    spark.createDataFrame(texts_, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.id, r.relevance) for r in R.queries["reranked__R13"](spark, str(tmp_path)).collect()]
    assert got == [(1, 1.0), (2, 0.666667)]


def test_rows_of_a_bucket_are_paired_and_verified(spark):
    from lodestrand.operators.pairs import near_duplicate_vectors

    draw = random.Random(2)
    x = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(3)]
    rows = [(1, x[0]), (2, x[0]), (3, [2 * v for v in x[0]]), (4, x[1]), (5, [v + 0.001 for v in x[1]]), (6, x[2]), (7, [0.0] * 64), (8, [0.0] * 64), (9, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in near_duplicate_vectors(df, "vec_id", "embedding", vectors.hyperplanes(64), 0.9).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)}


def test_every_asked_vector_is_searched(spark):
    from lodestrand.operators.knn import nearest_rows

    draw = random.Random(9)
    rows = [(k, [draw.gauss(0, 1) for _ in range(8)]) for k in range(300)] + [(300, [1.0]), (301, None), (302, [float("nan")] * 8)]
    rows += [(400 + k, rows[50][1]) for k in range(20)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got: dict = {}
    for r in nearest_rows(df, df.where("id % 50 = 0"), "id", "v", 5).orderBy("asked", "rank").collect():
        got.setdefault(r.asked, []).append(r.id)
    usable = {k: v for k, v in rows if v and len(v) == 8 and v[0] == v[0]}
    want = {a: sorted(usable, key=lambda k: (math.dist(usable[a], usable[k]), k))[:5] for a in usable if a % 50 == 0}
    assert got == want | {300: [300]} and len(got) == 8


def test_postings_index(spark, tmp_path):
    from lodestrand.operators.postings import PostingsIndex

    texts = [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 9))) for k in range(60)] + [(60, None), (61, ""), (None, "w1")]
    docs = spark.createDataFrame(texts, "id bigint, text string")
    index = PostingsIndex.build(docs, "id", F.col("text"), str(tmp_path / "whole"))
    same = lambda x, y: [(r.id, r.hits, round(r.score, 9), r.rank) for r in x.orderBy("rank").collect()] == [(r.id, r.hits, round(r.score, 9), r.rank) for r in y.orderBy("rank").collect()]
    for query, mode in (("w1 w3", "auto"), ("w1 w3", "or"), ("w2 w4", "and"), ("w1 nowhere", "auto"), ("nowhere", "or"), ("w1 nowhere", "and"), ("", "auto")):
        assert same(index.search(query, mode, 50), search.bm25(docs.where("id is not null"), "id", F.col("text"), query, mode, 50)), (query, mode)
    scope = docs.where("id > 30").select("id")
    assert same(index.search("w1 w3", "auto", 50, scope), search.bm25(docs.where("id is not null"), "id", F.col("text"), "w1 w3", "auto", 50, keep=F.col("id") > 30))
    opened = {f.split("bucket=")[1].split("/")[0] for f in index._of_terms("postings", ["w1"]).inputFiles()}
    assert opened == {str(zlib.crc32(b"w1") % 64)}
    part = PostingsIndex.build(docs.where("id < 20"), "id", F.col("text"), str(tmp_path / "part"))
    assert part.repair(docs, "id", F.col("text")) == 42 and part.repair(docs, "id", F.col("text")) == 0
    assert sorted(map(tuple, part.counts().collect())) == sorted(map(tuple, index.counts().collect())) and part.sums() == index.sums()
    assert {r.id for r in index.unindexed(docs, "id").collect()} == {k for k, t in texts if k is not None and not t} | {None}
    (tmp_path / "part" / "g1" / "sums" / "_SUCCESS").unlink()  # as if the repair had broken off
    assert part.repair(docs, "id", F.col("text")) == 42 and sorted(map(tuple, part.counts().collect())) == sorted(map(tuple, index.counts().collect()))
    empty = PostingsIndex.build(docs.limit(0), "id", F.col("text"), str(tmp_path / "empty"))
    assert empty.search("w1").count() == 0 and empty.counts().count() == 0


def test_shaped_tools():
    from lodestrand.operators import shaping

    tools = {"search": lambda query, project=None: f"{project}: " + "word " * 4000, "read": lambda: '{"a": "' + "x" * 9000 + '"}', "explore": lambda: "y" * 9000, "hidden": lambda: ""}
    got = shaping.shaped(tools, ("search", "read", "explore", "gone"), project=7, uncapped=("explore",))
    assert set(got) == {"search", "read", "explore"}
    text = got["search"](query="word")
    assert text.startswith("7: ") and len(text) < shaping.CAP + 200 and got["search"](query="word", project=3).startswith("3: ")
    assert len(got["read"]()) == 9009 and len(got["explore"]()) == 9000
    said = shaping.empty_result(shaping.Ran("hybrid", "question phrasing", 0, failed="no store"), "no index yet")
    assert "failed: no store" in said and "may still exist" in said and said.endswith("no index yet")
    assert shaping.degraded_note(shaping.Ran("fts")) is None and "word hits only" in shaping.degraded_note(shaping.Ran("fts", failed="x"))


def test_hashes_of_many():
    data = [b"", b"a", b"vec-123", bytes(range(256)) * 3, b"\x00\x00", b"b"]
    assert texts.fnv_53_all(data).tolist() == [texts.fnv_53(d) for d in data] and texts.fnv_53_all([]).tolist() == []


def test_reranked_by_a_pair_model(spark):
    from lodestrand.operators import rerank

    def model(pairs):
        if any("bad" in t for _, t in pairs):
            raise ValueError
        return [float(len(set(q.split()) & set(t.split()))) * 50 - 100 for q, t in pairs]

    hits = spark.createDataFrame([(k, k, t) for k, t in enumerate(["a x", "a b", None, "a b c", "bad"], 1)], "id bigint, rank int, text string").coalesce(1)
    got = [(r.id, r.place) for r in rerank.reranked(hits, "a b c", "text", model, 9, 1).orderBy("place").collect()]
    assert got == [(4, 1), (2, 2), (1, 3), (3, 4), (5, 5)]
    assert [r.id for r in rerank.reranked(hits, "a b c", "text", model, 2, 16).orderBy("place").collect()] == [1, 2]  # the call fails: the order stays
    assert rerank.sigmoid(0) == 0.5 and rerank.sigmoid(-1000) == 0 and rerank.sigmoid(1000) == 1 and rerank.sigmoid(float("nan")) == 0
    assert rerank.cut_by(0.4)(rerank.reranked(hits, "a b c", "text", model, 9, 1)).count() == 3
    assert rerank.reranked(hits.limit(0), "a", "text", model, 3).count() == 0


def test_ranks_by_ranges(spark):
    draw = random.Random(3)
    data = [(draw.choice(["hot"] * 6 + ["b", None]), draw.randrange(40), k) for k in range(400)]
    df = spark.createDataFrame(data, "g string, n int, id int")
    got = {r.id: r.rank for r in fusion.ranked(df, ["g"], [F.desc("n"), F.asc("id")]).collect()}
    for g in ("hot", "b", None):
        own = sorted((-n, k) for x, n, k in data if x == g)
        assert [got[k] for _, k in own] == list(range(1, len(own) + 1))
    assert fusion.ranked(df.limit(0), ["g"], [F.asc("id")]).count() == 0
