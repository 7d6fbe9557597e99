"""Merge algebra, graph, rolling totals, reducers, sources and streams on small frames."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import paths
from lodestrand.operators import graph, merge, reducers
from lodestrand.operators.cache import KeyedLocks
from lodestrand.operators.rolling import rolling_totals
from lodestrand.sources import config, records, scan, skeleton, stores, symbols, versions
from lodestrand.streaming import changes


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_rolling_totals(spark):
    data = [("a", "2025-01-01 23:59:59.999999", 1.0), ("a", "2025-01-01 00:00:00", None), ("a", "2025-01-10 00:00:00", 2.0), ("a", "2025-01-10 00:00:00", 2.0), ("b", "2025-02-28 10:00:00", float("nan")), (None, "2025-01-05 00:00:00", 9.0), ("a", None, 9.0)]
    df = spark.createDataFrame(data, "who string, at string, usd double").select("who", F.col("at").cast("timestamp_ntz").alias("at"), "usd", F.lit(1).alias("day"), F.lit(2).alias("entity"))
    got = {(r.who, str(r.day)): r for r in rolling_totals(df, "who", "at", "usd", (7, 30)).collect()}
    assert len(got) == 11 and got["a", "2025-01-07"].rows_7 == 2 and got["a", "2025-01-08"].rows_7 == 0 and got["a", "2025-01-08"].rows_30 == 2
    end = got["a", "2025-01-10"]
    assert (end.total_7, end.avg_7, end.total_30, end.rows_30) == (4.0, 2.0, 5.0, 4) and abs(end.day_avg_30 - 0.5) < 1e-12 and abs(end.day_avg_7 - 4 / 7) < 1e-12
    assert got["b", "2025-02-28"].avg_7 is None and got["b", "2025-02-28"].total_7 == 0
    assert rolling_totals(df.limit(0), "who", "at", "usd").count() == 0


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "k int, h string, s string")
    new = spark.createDataFrame([(1, "a", None), (2, "B", "n"), (4, "d", None)], "k int, h string, s string")
    assert rows(merge.classified(old, new, ["k"], "h"), "k", "kind") == [(1, "unchanged"), (2, "modified"), (3, "removed"), (4, "added")]
    once = merge.upserted(old, new, ["k"], ["s"])
    assert rows(once, "k", "h", "s") == [(1, "a", "x"), (2, "B", "n"), (3, "c", "z"), (4, "d", None)]
    assert rows(merge.upserted(once, new, ["k"], ["s"]), "k", "h", "s") == rows(once, "k", "h", "s")
    assert rows(merge.counted_upsert(spark.createDataFrame([("v", 2)], "id string, attempts int"), spark.createDataFrame([("v",), ("w",), ("w",)], "id string"), ["id"]), "id", "attempts") == [("v", 3), ("w", 1)]
    versions = merge.versioned(spark.createDataFrame([(1, 10), (1, 20)], "k int, at int"), ["k"], ["at"])
    assert rows(versions, "version", "valid_from", "valid_to") == [(1, 10, 20), (2, 20, None)]
    assert [r.at for r in merge.changed_revisions(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, at int, h string"), ["k"], ["at"], "h").orderBy("at").collect()] == [1, 3, 5]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 2)], "project_id int, source_file_id int, target_file_id int")
    assert rows(graph.two_cycles(edges), "a", "b") == [(1, 2)]
    assert rows(graph.indegrees(edges), "file_id", "dependents") == [(1, 1), (2, 3), (3, 1)]
    assert rows(graph.reach(edges, spark.createDataFrame([(2,)], "seed int"), 2), "node", "depth") == [(1, 1), (3, 1), (4, 2), (5, 1)]
    got = graph.expanded(spark.createDataFrame([(4, 1), (5, 2)], "file_id int, rank int"), edges).orderBy(F.desc("score")).collect()
    assert [(r.file_id, r.hits, r.best_seed) for r in got] == [(3, 1, 1), (2, 1, 2)] and abs(got[0].score - 1 / 61) < 1e-12


def test_smoke_index(spark):
    """Two files: a class with methods, and a caller that imports it."""
    service = "export class AuthService {\n  login(name: string) { return name; }\n  logout() { return 1; }\n}\n"
    main = 'import { AuthService } from "./auth.service";\nexport function boot() { return new AuthService(); }\n'
    files = spark.createDataFrame([(1, 1, "src/auth.service.ts"), (2, 1, "src/main.ts")], "id int, project_id int, path string")
    contents = spark.createDataFrame([(1, 1, service, True), (2, 1, main, True)], "file_id int, project_id int, content string, supported boolean")
    assert rows(skeleton.skeletons(files, contents), "file_id", "kind", "name") == [(1, "class", "AuthService"), (2, "function", "boot")]
    imports = spark.createDataFrame([(1, 2, "src", "./auth.service"), (1, 2, "src", "../lost"), (1, 2, "src/deep/er", "../../auth.service.js")], "project_id int, file_id int, directory string, import_path string")
    assert rows(graph.resolved_imports(imports, files), "import_path", "target_file_id") == [("../../auth.service.js", 1), ("../lost", None), ("./auth.service", 1)]
    calls = graph.call_sites(contents, spark.createDataFrame([(1, "AuthService", 1, 7)], "project_id int, name string, file_id int, id int"))
    assert rows(calls, "file_id", "name", "line") == [(2, "AuthService", 2)]
    assert skeleton.body("a.ts", service, 2) == "  login(name: string) { return name; }" and skeleton.body("a.py", "def f():\n    a\n\n    b\nc", 1) == "def f():\n    a\n\n    b"


def test_reducers():
    log = "\n".join(f"commit {k:08x}\n    message {k} " + "x" * 60 for k in range(50))
    short = reducers.git_log(log, 1000)
    assert len(short) < 1100 and "elided" in short and short.startswith("commit 00000000") and reducers.git_log(short, 1200) == short
    diff = "\n".join(f"diff --git a/{k} b/{k}\n" + "\n".join(f"@@ -{h} +{h} @@\n" + "+line\n" * 20 for h in range(6)) for k in range(10))
    assert "hunk(s) elided" in reducers.git_diff(diff, 2000) and "entirely elided" in reducers.git_diff(diff, 2000)
    found = reducers.grep("\n".join(f"a.ts:{k}: hit" for k in range(30)) + "\nb.ts:1: hit", 100)
    assert found.count("a.ts:") == 8 and "b.ts:1" in found and "elided 22" in found
    logs = "\n".join(["2025-01-01T10:00:0%d.5Z same" % (k % 10) for k in range(25)] + ["other"])
    assert reducers.log_lines(logs).split("\n")[1].startswith("[same as previous × 24")
    listed = reducers.listing("\n".join([f"f{k}.ts" for k in range(30)] + ["g.py", "Makefile"]))
    assert "32 total entries" in listed and "  .ts: 30" in listed and "(no extension): 1" in listed
    run = "$ pytest -q\nexit code: 1\n--- stdout ---\n" + "ok\n" * 40 + "=== FAILURES ===\nboom"
    assert "FAILURES section onward" in reducers.run_command(run, 60) or "chars elided" in reducers.run_command(run, 60)
    assert reducers._by_command(reducers._envelope(run)).endswith("kept FAILURES section onward]")
    status = "On branch main\n  (use \"git add\")\n" + "\n".join(f"\tmodified: {k}" for k in range(9))
    assert reducers.status(status).endswith("... 4 more file(s)") and "(use" not in reducers.status(status)
    pushed = reducers._envelope("$ git push\nexit code: 0\n--- stderr ---\nTo x\n   abc..def  main -> main\nnoise")
    assert "main -> main" in reducers._by_command(pushed) and "noise" not in reducers._by_command(pushed)
    table = json.dumps([{"id": k % 30, "text": f"row {k % 30} " + "y" * 30} for k in range(60)])
    crushed = reducers.json_crush(table, 900, "row 17")
    assert "dropped 30 duplicate(s)" in crushed and '"id":17' in crushed and '"id":0' in crushed and '"id":29' in crushed and len(crushed) < 1000
    assert reducers.reduce_text("unknown", "short", 100) == "short" and reducers.run_command("x" * 500, 100).startswith("x" * 40)


def test_config():
    text = '{ // base\n "compilerOptions": { "baseUrl": "./src", "paths": { "@/*": ["./app/*", "lib/*",], /* c */ "x": ["y"] }, } }'
    assert config.path_aliases(text) == [("@/", ["src/app", "src/lib"]), ("x", ["src/y"]), ("", ["src"])] and config.path_aliases("{") == []
    assert config.coerced({"a": "true", "b": "12", "c": "1.5", "d": "x"}) == {"a": True, "b": 12, "c": 1.5, "d": "x"}
    assert config.analysis('so: {"summary": "s", "concepts": ["a", "", "b"], "layer": "data"}') == {"summary": "s", "concepts": ["a", "b"], "layer": "data"}
    assert config.analysis("plain text")["summary"] == "plain text"


def test_scan_and_run(spark, tmp_path):
    for name, text in (("src/a.py", "x = 1\n"), ("src/b.min.js", "f()"), ("node_modules/c.js", "f()"), ("docs/d.md", "# d"), ("skip/e.py", "y = 2")):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    now = scan.scanned(spark, str(tmp_path), ["skip/"])
    assert rows(now, "path", "language", "index_tier", "line_count") == [("docs/d.md", "markdown", "on_demand", 1), ("src/a.py", "python", "support", 2)]
    known = spark.createDataFrame([("src/a.py", "old"), ("gone.py", "h")], "path string, content_hash string")
    run = scan.index_run(known, now)
    assert run["verdict"] == "ok" and rows(run["changes"], "path", "kind") == [("docs/d.md", "added"), ("gone.py", "removed"), ("src/a.py", "modified")]
    assert scan.index_run(known, now.limit(0))["verdict"] == "empty_scan" and scan.index_run(known, now, 1)["verdict"] == "too_large"


def test_vector_store(spark, tmp_path):
    store = stores.vector_store(spark, "parquet", path=str(tmp_path / "v"))
    make = lambda *r: spark.createDataFrame([(v, e, ns, "p", "file", v) for v, e, ns in r], stores.VECTORS)
    assert store.search([1.0, 0.0], 3).count() == 0
    store.upsert(make(("a", [1.0, 0.0], "n1"), ("b", [0.0, 1.0], "n1"), ("c", [1.0, 1.0], "n2")))
    store.upsert(make(("a", [0.9, 0.0], "n1")))
    assert [r.vid for r in store.search([1.0, 0.0], 2).collect()] == ["a", "c"] and store.search([1.0, 0.0], 9, {"namespace": "n1"}).count() == 2
    with pytest.raises(ValueError):
        store.upsert(make(("d", [1.0], "n1")))
    store.delete(spark.createDataFrame([("a",)], "vid string"))
    store.delete_namespace("n2")
    assert rows(store.ids(), "vid") == [("b",)]
    null = stores.vector_store(spark, "null")
    assert null.search([1.0], 1).count() == 0 and stores.RoutingVectorStore(store, {"x": null}).route("x") is null and stores.RoutingVectorStore(store, {}).route("x") is store
    with pytest.raises(ValueError):
        stores.vector_store(spark, "elsewhere")
    df = spark.createDataFrame([(1, "a b", None, "h"), (2, "a b", "h", "h")], "id int, t string, embedding_hash string, content_hash string")
    got = stores.backfill(df, "t", "content_hash", 8).collect()
    assert [r.id for r in got] == [1] and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-6


def test_streams_equal_batches(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    events = [(1, "a", "upsert", False, 1, "2025-01-01T00:00:00"), (1, "a", "delete", False, 2, "2025-01-01T00:00:01"), (1, "b", "upsert", False, 3, "2025-01-01T00:00:01"), (1, "d", "upsert", True, 4, "2025-01-01T00:00:09"), (2, "a", "upsert", False, 5, "2025-01-01T00:01:00")]
    names = ("project_id", "path", "kind", "is_dir", "seq", "ts")
    (inbox / "1.json").write_text("\n".join(json.dumps(dict(zip(names, e))) for e in events))
    stream = changes.change_stream(spark, str(inbox))
    seen = []
    changes.refresh(stream, target, str(tmp_path / "cp"), lambda df, n: seen.append(n)).awaitTermination()
    assert rows(changes.current(spark, target), "project_id", "path") == [(1, "b"), (2, "a")] and seen == [0]
    (inbox / "2.json").write_text(json.dumps(dict(zip(names, (1, "b", "delete", False, 6, "2025-01-01T00:02:00")))))
    changes.refresh(changes.change_stream(spark, str(inbox)), target, str(tmp_path / "cp")).awaitTermination()
    assert rows(changes.current(spark, target), "project_id", "path") == [(2, "a")]
    query = changes.debounced(changes.change_stream(spark, str(inbox)), ["project_id"], "ts", "1500 milliseconds", "0 seconds").writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert (1, 3) in rows(spark.table("batches"), "project_id", "n")
    batch = spark.read.schema(changes.EVENTS).json(str(inbox))
    query = changes.windowed(changes.change_stream(spark, str(inbox)), ["kind"], "ts", "1 minute", late="0 seconds").writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = batch.groupBy("kind", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    assert rows(spark.table("minutes"), "kind", "n") == rows(want, "kind", "n")
    assert rows(changes.touches(batch.withColumn("e", F.col("kind") == "delete"), "path", "seq", "e"), "path", "last", "edited") == [("a", 5, True), ("b", 6, True), ("d", 4, False)]


def test_replayed_batches_change_nothing(spark, tmp_path):
    """A commit that was lost, a manifest that was never written, and a table seen by its reader throughout."""
    inbox, target, cp = tmp_path / "in", tmp_path / "table", tmp_path / "cp"
    inbox.mkdir()
    names = ("project_id", "path", "kind", "is_dir", "seq", "ts")

    def send(number, *events):
        (inbox / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(names, (1, p, k, False, s, "2025-01-01T00:00:00")))) for p, k, s in events))

    def run():
        changes.refresh(changes.change_stream(spark, str(inbox)), str(target), str(cp)).awaitTermination()
        return [r.path for r in changes.current(spark, str(target)).orderBy("path").collect()]

    def forget(number):
        for name in (str(number), f".{number}.crc"):
            (cp / "commits" / name).unlink(missing_ok=True)

    assert changes.current(spark, str(target)).count() == 0
    send(0, *((f"p{k}", "upsert", k) for k in range(30)))
    assert run() == sorted(f"p{k}" for k in range(30))
    forget(0)
    assert run() == sorted(f"p{k}" for k in range(30))
    send(1, ("a", "upsert", 100), ("p3", "delete", 101))
    want = sorted({f"p{k}" for k in range(30)} - {"p3"} | {"a"})
    assert run() == want
    forget(1)  # the version is there, Spark's commit is not
    assert run() == want
    forget(1)
    (target / "m1").unlink()  # its data is there, the version is not
    assert run() == want
    first = {p.name for p in (target / "d0").iterdir()}
    assert len({p.name for p in (target / "d1").iterdir() if p.is_dir()}) <= 2 < len(first)
    for k in range(2, 7):
        send(k, (f"q{k}", "upsert", 200 + k))
        run()
    assert run() == sorted([*want, *(f"q{k}" for k in range(2, 7))])
    assert len([p for p in target.iterdir() if p.name[0] == "m"]) == versions.KEPT
    send(7, *((p, "delete", 300) for p in [*want, *(f"q{k}" for k in range(2, 7))]))
    assert run() == []


def test_locks_by_key():
    locks, seen, inside = KeyedLocks(), [], []

    def work(key, k):
        with locks.holding(key):
            inside.append(key)
            assert inside.count(key) == 1
            time.sleep(0.01)
            inside.remove(key)
            seen.append(k)

    threads = [threading.Thread(target=work, args=("ab"[k % 2], k)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(seen) == list(range(8)) and len(locks) == 0


def test_embedding_calls_are_batched_and_retried():
    sizes, failed = [], []

    def model(texts):
        sizes.append(len(texts))
        if len(texts) > 4:
            raise ValueError("too long")
        if "flaky" in texts and not failed:
            failed.append(1)
            raise OSError
        return [[float(len(t))] for t in texts]

    texts = ["a" * k for k in range(1, 11)] + ["flaky"]
    assert stores.in_batches(texts, model, 8) == [[float(len(t))] for t in texts] and failed and max(sizes) == 8
    with pytest.raises(ZeroDivisionError):
        stores.in_batches(["x"], lambda t: 1 / 0)


def brief(path, text):
    return [(s.name, s.kind, s.parent, s.line, s.end_line) for s in symbols.symbols_of(path, text)]


def test_symbols_of_scripts():
    text = "export class AuthService {\n  #key = 1\n  constructor(a: string) { if (a) { b() } }\n  async login(name: string) {\n    const inner = 1\n    function deep() {}\n  }\n  get x(): number { return 2 }\n}\n"
    assert brief("a.ts", text) == [("AuthService", "class", None, 1, 9), ("constructor", "method", "AuthService", 3, 3), ("login", "method", "AuthService", 4, 7), ("x", "method", "AuthService", 8, 8)]
    text = "// function no() {}\nconst LIMIT = {\n  a: 1,\n}\nexport const f = async (x) => {\n  return `class N {`\n}\nexport interface P { a(): void }\ntype T = { a: 1 }\nenum E { A }\nif (x) { function hidden() {} }\nexport default function g() { return /[{]/ }\n"
    got = symbols.symbols_of("b.ts", text)
    assert [(s.name, s.kind, s.line, s.end_line) for s in got if s.parent is None] == [("LIMIT", "constant", 2, 4), ("f", "function", 5, 7), ("P", "interface", 8, 8), ("T", "type", 9, 9), ("E", "enum", 10, 10), ("g", "function", 12, 12)]
    assert {s.name: s.exported for s in got}["f"] and not {s.name: s.exported for s in got}["LIMIT"] and got[-1].signature == "export default function g()"


def test_symbols_of_other_languages():
    python = "import os\nLIMIT = [\n  1,\n]\n\n@dec\nclass A(B):\n    size: int = 3\n    def f(self,\n          x=1):\n        def inner(): pass\n        return 'class C:'\n\n    class N:\n        def g(self): pass\n\nasync def h(): pass\n"
    assert brief("a.py", python) == [("LIMIT", "constant", None, 2, 4), ("A", "class", None, 7, 15), ("size", "constant", "A", 8, 8), ("f", "method", "A", 9, 12), ("N", "class", "A", 14, 15), ("g", "method", "N", 15, 15), ("h", "function", None, 17, 17)]
    java = "package a;\npublic final class A<T> {\n  private static final int MAX = 3;\n  A() { }\n  @Override\n  public List<Map<String, T>> f(int[] a) throws X {\n    for (int i = 0; i < 3; i++) { g(i); }\n    return null;\n  }\n  enum K { A, B }\n  abstract int h();\n}\n"
    assert brief("A.java", java) == [("A", "class", None, 2, 12), ("MAX", "constant", "A", 3, 3), ("A", "method", "A", 4, 4), ("f", "method", "A", 6, 9), ("K", "enum", "A", 10, 10), ("h", "method", "A", 11, 11)]
    go = "package a\n\nconst MAX = 3\n\ntype S struct {\n\tA int\n}\n\nfunc (s *S) Get() int {\n\treturn 1\n}\n\nfunc run() { x := func() {} }\n"
    assert brief("a.go", go) == [("MAX", "constant", None, 3, 3), ("S", "class", None, 5, 7), ("Get", "method", "S", 9, 11), ("run", "function", None, 13, 13)]
    for path, text in (("a.py", None), ("a.md", "x"), (None, "x"), ("a.ts", ""), ("a.ts", "class A {"), ("a.py", "def f(:"), ("A.java", "class A { void f("), ("a.go", "func (")):
        symbols.symbols_of(path, text)


def test_required_shapes_of_a_graph(spark, tmp_path):
    """A 2-cycle beside an acyclic edge, a hub of four, an unresolved and an aliased import, and edges stored by project."""
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 7, 8)], "project_id bigint, source_file_id bigint, target_file_id bigint")
    stored = graph.StoredEdges(spark, str(tmp_path / "edges"))
    stored.replace(edges)
    stored.replace(edges.where("project_id = 2"))
    assert rows(stored.read(), "source_file_id", "target_file_id") == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (7, 8)] and stored.read(2).count() == 1
    assert rows(graph.two_cycles(stored.read()), "project_id", "a", "b") == [(1, 1, 2)]
    degree = graph.indegrees(stored.read())
    tiers = degree.select("file_id", paths.promoted(F.lit("support"), F.col("dependents")).alias("tier"))
    assert rows(tiers, "file_id", "tier") == [(1, "core"), (2, "support"), (8, "support")]
    assert rows(graph.reach(stored.read(), spark.createDataFrame([(2,)], "seed bigint"), 3), "node", "depth") == [(1, 1), (3, 2), (4, 2), (5, 2)]
    found = graph.expanded(spark.createDataFrame([(1, 1)], "file_id bigint, rank int"), stored.read())
    assert rows(found, "file_id", "hits") == [(2, 1), (3, 1), (4, 1), (5, 1)]
    files = spark.createDataFrame([(1, 1, "src/a/main.ts"), (2, 1, "src/a/auth.service.ts"), (3, 1, "src/lib/index.ts"), (4, 1, "src/lib/deep/x.js")], "id bigint, project_id bigint, path string")
    asked = ("./auth.service", "../lib", "./gone", "@lib/deep/x", "@lib/deep/none", "react", "@other/y")
    imports = spark.createDataFrame([(1, 1, "src/a", p) for p in asked], "project_id bigint, file_id bigint, directory string, import_path string")
    aliases = spark.createDataFrame([(1, "@lib/", "src/lib"), (1, "@", "nowhere"), (2, "@other/", "src")], "project_id bigint, prefix string, target string")
    assert dict(rows(graph.resolved_imports(imports, files, aliases), "import_path", "target_file_id")) == {"./auth.service": 2, "../lib": 3, "./gone": None, "@lib/deep/x": 4, "@lib/deep/none": None, "react": None, "@other/y": None}


def test_vector_shards(spark, tmp_path):
    make = lambda *r: spark.createDataFrame([(v, e, "n", p, "file", v) for v, e, p in r], stores.VECTORS)
    central, own = (stores.vector_store(spark, "parquet", path=str(tmp_path / x)) for x in ("central", "own"))
    central.upsert(make(*((f"v{k}", [float(k), 1.0], "ab"[k % 2]) for k in range(20))))
    touched = len(list((tmp_path / "central" / "d0").glob("b=*")))
    central.upsert(make(("v1", [9.0, 9.0], "b")))
    assert len(list((tmp_path / "central" / "d1").glob("b=*"))) == 1 < touched
    assert central.split("b", own) == 10 and own.read().count() == 10 and central.read().where("project_name = 'b'").count() == 0
    assert rows(own.read().where("vid = 'v1'"), "embedding") == [([9.0, 9.0],)]
    assert central.split("b", own) == 0 and central.held.backup(str(tmp_path / "copy")) == 10
    central.held.vacuum()
    assert len(central.held.numbers()) == 1 and central.read().count() == 10
    own.purge("b")
    assert own.read().count() == 0


def test_records(spark, tmp_path):
    hooks = records.Records(spark, str(tmp_path / "hooks"), "id bigint, url string, events array<string>, active boolean", ["id"])
    row = lambda *r: spark.createDataFrame([r], "id bigint, url string, events array<string>, active boolean")
    hooks.insert(row(1, "u", ["a"], True))
    hooks.insert(row(1, "other", [], False))
    hooks.insert(row(2, "w", None, None))
    hooks.upsert(row(1, None, ["b"], False), ["url"])
    assert rows(hooks.list(), "id", "url", "events", "active") == [(1, "u", ["b"], False), (2, "w", None, None)] and hooks.one(id=2).count() == 1
    hooks.delete(spark.createDataFrame([(2,), (7,)], "id bigint"))
    assert rows(hooks.list(F.col("active") == False), "id") == [(1,)]  # noqa: E712
    costs = records.Records(spark, str(tmp_path / "costs"), "project_id bigint, usd double", ["project_id"])
    for _ in range(2):
        costs.append(spark.createDataFrame([(1, 0.5)], "project_id bigint, usd double"))
    assert costs.list().count() == 2


@pytest.fixture
def service():
    """A small server that keeps vectors and answers in the four services' forms."""
    import http.server

    kept, calls = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            raw = self.rfile.read(int(self.headers["Content-Length"])).decode()
            calls.append((self.path, self.headers["Api-Key"]))
            if len(calls) == 1:
                self.send_response(503)
                self.end_headers()
                return
            lines = [json.loads(x) for x in raw.splitlines()] if "ndjson" in self.headers["Content-Type"] else [json.loads(raw)]
            out = json.dumps(self.answer(self.path, lines)).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        do_PUT = do_POST

        def answer(self, path, lines):
            body = lines[0]
            if path == "/_bulk?refresh=true":
                for k, one in enumerate(lines):
                    if "index" in one:
                        kept[one["index"]["_id"]] = (lines[k + 1].pop("embedding"), lines[k + 1])
                    if "delete" in one:
                        kept.pop(one["delete"]["_id"], None)
                return {"errors": False}
            if path.endswith("/upsert") or "/points?" in path:
                for one in body.get("vectors") or body.get("points") or lines:
                    kept[one["id"]] = (one.get("values") or one["vector"], one.get("metadata") or one["payload"])
                return {}
            if "delete" in path:
                for one in body.get("ids") or body["points"]:
                    kept.pop(one, None)
                return {}
            knn = body.get("query", {}).get("knn", {}).get("embedding", {}) if isinstance(body.get("query"), dict) else {}
            asked, k = body.get("vector") or knn["vector"], body.get("topK") or body.get("limit") or body["size"]
            wanted = json.dumps(body.get("filter") or knn.get("filter") or {})
            near = sorted(((sum(a * b for a, b in zip(asked, v)), i, m) for i, (v, m) in kept.items() if "type" not in wanted or f'"{m.get("type")}"' in wanted), key=lambda r: -r[0])[:k]
            if "/points/" in path:
                return {"result": [{"id": i, "score": s, "payload": m} for s, i, m in near]}
            if "_search" in path:
                return {"hits": {"hits": [{"_id": i, "_score": s, "_source": m} for s, i, m in near]}}
            matches = [{"id": i, "score": s, "metadata": m} for s, i, m in near]
            return {"result": {"matches": matches}} if "vectorize" in path else {"matches": matches}

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", kept, calls
    server.shutdown()


@pytest.mark.parametrize("kind", ["qdrant", "pinecone", "opensearch", "vectorize"])
def test_vector_services(spark, service, kind):
    url, kept, calls = service
    store = stores.vector_store(spark, kind, url=url, index="i", headers={"Api-Key": "k"})
    data = [(f"v{k}", [float(k % 7), 1.0, float(k)], None, "p", "file" if k % 2 else "symbol", str(k)) for k in range(130)]
    df = spark.createDataFrame([*data, data[0], ("none", None, None, None, None, None)], stores.VECTORS).coalesce(1)
    assert store.upsert(df) == 130 and len(kept) == 130 and {c[1] for c in calls} == {"k"}
    assert rows(store.search([0.0, 0.0, 1.0], 2), "vid", "type", "ref_id") == [("v128", "symbol", "128"), ("v129", "file", "129")]
    assert [r.vid for r in store.search([0.0, 0.0, 1.0], 1, {"type": "symbol"}).collect()] == ["v128"]
    assert store.delete(spark.createDataFrame([("v129",), ("gone",)], "vid string")) == 2 and len(kept) == 129
    with pytest.raises(OSError):
        stores.vector_store(spark, kind, url="http://127.0.0.1:9", index="i").search([1.0], 1)


def test_late_rows_and_restarts_of_a_stream(spark, tmp_path):
    """A stream that goes on from its checkpoint counts each batch once, and drops what comes behind the watermark."""
    inbox = tmp_path / "in"
    inbox.mkdir()

    def send(number, *times):
        (inbox / f"{number}.json").write_text("\n".join(json.dumps({"project_id": 1, "path": "p", "kind": "upsert", "is_dir": False, "seq": k, "ts": t}) for k, t in enumerate(times)))

    def run():
        stream = changes.debounced(changes.change_stream(spark, str(inbox)), ["project_id"], "ts", "2 seconds", "10 seconds")
        stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")), "started", "n")

    send(0, "2025-01-01T00:00:00", "2025-01-01T00:00:01", "2025-01-01T00:05:00")
    assert [n for _, n in run()] == [2]
    send(1, "2025-01-01T00:00:01", "2025-01-01T00:05:01", "2025-01-01T00:10:00")  # the first comes minutes late
    assert [n for _, n in run()] == [2, 2]
    assert [n for _, n in run()] == [2, 2]


def test_aliases_of_projects():
    text = '{"compilerOptions": {"baseUrl": "src", /* c */ "paths": {"@lib/*": ["lib/*", "old/lib/*"]}}}'
    assert config.alias_rows({4: text, 5: "no"}) == [(4, "@lib/", "src/lib"), (4, "@lib/", "src/old/lib"), (4, "", "src")]
