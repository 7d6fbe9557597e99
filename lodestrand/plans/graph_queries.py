"""Dependency graph, references, hierarchy and reports over them. Edges are call references between files of a project."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import paths
from lodestrand.operators import graph, reducers
from lodestrand.plans.registry import Registry
from lodestrand.session import shared_folder
from lodestrand.sources import skeleton, symbols

R = Registry()
q = R.add

_CALLS = r"""
lines as (select project_id, file_id, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from file_contents where content is not null),
called as (select project_id, file_id, line, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1))) as name from lines where contains(text, '(')),
known as (select * from called c where exists (select 1 from symbols s where s.project_id = c.project_id and s.name = c.name)),
calls as (select project_id, file_id, name, cast(line as int) as line from (select *, row_number() over (partition by file_id order by line, name) as rn from known) where rn <= 400)"""
_EDGES = _CALLS + """,
defined as (select project_id, name, min_by(file_id, id) as target_file_id from symbols group by 1, 2),
edges as (select distinct c.project_id, c.file_id as source_file_id, target_file_id from calls c join defined d on d.project_id = c.project_id and d.name = c.name where c.file_id <> target_file_id),
degree as (select project_id, target_file_id as file_id, count(*) as dependents from edges group by 1, 2)"""


def _calls(t):
    return graph.call_sites(t.file_contents, t.symbols)


_stored: dict[tuple[str, str], graph.StoredEdges] = {}


def _edges(t):
    """The stored edges of the tables, derived from the texts once a session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _stored:
        held = graph.StoredEdges(t.spark, f"{shared_folder(t.spark)}/edges-{key[0]}-{len(_stored)}")
        held.replace(graph.reference_edges(_calls(t), t.symbols))
        _stored[key] = held
    return _stored[key].read()


# Trade between nations, from the supplier's to the customer's, is a graph with cycles and hubs: the graph operators run on it beside the sparse one of files.
_TRADE = """trade as (select distinct 0 as project_id, s_nationkey as source_file_id, c_nationkey as target_file_id from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
where l_returnflag = 'R' and l_quantity >= 49 and o_orderpriority like '1%' and s_nationkey <> c_nationkey),
fan as (select target_file_id as node, count(*) as dependents from trade group by 1)"""


def _trade(t):
    lines = t.lineitem.where("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey", "l_suppkey")
    orders = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    rows = lines.join(orders, "l_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rows.where("s_nationkey <> c_nationkey").select(F.lit(0).alias("project_id"), F.col("s_nationkey").alias("source_file_id"), F.col("c_nationkey").alias("target_file_id")).distinct()


@q("trade_cycles__G3", f"with {_TRADE} select a.source_file_id as a, a.target_file_id as b from trade a join trade b on a.source_file_id = b.target_file_id and a.target_file_id = b.source_file_id where a.source_file_id < a.target_file_id")
def trade_cycles(t):
    return graph.two_cycles(_trade(t)).select("a", "b")


@q("trade_hubs__G2", f"with {_TRADE} select node, n_name, dependents, dependents >= 4 as promoted from fan join nation on n_nationkey = node")
def trade_hubs(t):
    """Nations by how many others supply them; from four on a file would be promoted."""
    degree = graph.indegrees(_trade(t)).select(F.col("file_id").alias("node"), "dependents")
    tier = paths.promoted(F.lit("support"), F.col("dependents")) == "core"
    return degree.join(t.nation.select(F.col("n_nationkey").alias("node"), "n_name"), "node").select("node", "n_name", "dependents", tier.alias("promoted"))


@q("trade_traced__G6", f"""with recursive {_TRADE}, walk(seed, node, depth) as (select n_nationkey, n_nationkey, 0 from nation where n_regionkey = 1 union select w.seed, e.source_file_id, w.depth + 1 from walk w join trade e on e.target_file_id = w.node where w.depth < 2)
select seed, node, cast(min(depth) as int) as depth from walk where node <> seed group by 1, 2""")
def trade_traced(t):
    """Nations that reach those of a region within two steps."""
    seeds = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("seed"))
    return graph.reach(_trade(t), seeds, 2).where("node <> seed")


@q("trade_expanded__R6", f"""with {_TRADE}, primary_ as (select c_nationkey as node, row_number() over (order by count(*) desc, c_nationkey) as rank from customer group by 1 qualify rank <= 6),
near as (select p.node, rank, other from (select distinct * from (select source_file_id as node, target_file_id as other from trade union all select target_file_id, source_file_id from trade)) b join primary_ p using (node) where rank <= 5 qualify row_number() over (partition by p.node order by other) <= 10),
found as (select other as file_id, count(*) as hits, min(rank) as best_seed from near where other not in (select node from primary_) group by 1)
select file_id, hits, cast(best_seed as int) as best_seed, round(1.0 / (60 + row_number() over (order by hits desc, best_seed, file_id)), 9) as score from found order by hits desc, best_seed, file_id limit 20""")
def trade_expanded(t):
    top = t.customer.groupBy(F.col("c_nationkey").alias("file_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_id").limit(6).select("file_id", F.row_number().over(Window.orderBy(F.desc("n"), "file_id")).alias("rank"))
    return graph.expanded(top, _trade(t)).withColumn("score", F.round("score", 9))


@q("trade_covering__J20", f"with {_TRADE} select target_file_id as node, source_file_id as flagged from trade join nation on n_nationkey = source_file_id where n_regionkey = 2")
def trade_covering(t):
    """Edges whose source is flagged, here by its region, as tests are among files."""
    flagged = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("source_file_id"))
    return _trade(t).join(flagged, "source_file_id", "left_semi").select(F.col("target_file_id").alias("node"), F.col("source_file_id").alias("flagged"))


@q("call_sites__S9", f"with {_CALLS} select * from calls")
def call_sites(t):
    return _calls(t)


@q("references__J18", f"with {_CALLS} select c.project_id, c.file_id, c.name, c.line, d.symbol_id from calls c join (select project_id, name, min(id) as symbol_id from symbols group by 1, 2) d on d.project_id = c.project_id and d.name = c.name")
def references(t):
    first = t.symbols.groupBy("project_id", "name").agg(F.min("id").alias("symbol_id"))
    return _calls(t).join(first, ["project_id", "name"]).select("project_id", "file_id", "name", "line", "symbol_id")


@q("edges__J17", f"with {_EDGES} select * from edges")
def edges(t):
    return _edges(t)


@q("dependencies__G1", f"with {_EDGES} select source_file_id, f.path as target_path from edges e left join files f on f.id = e.target_file_id")
def dependencies(t):
    return _edges(t).join(t.files.select(F.col("id").alias("target_file_id"), F.col("path").alias("target_path")), "target_file_id", "left").select("source_file_id", "target_path")


@q("dependents__J3", f"with {_EDGES} select target_file_id, f.path as source_path from edges e join files f on f.id = e.source_file_id")
def dependents(t):
    return _edges(t).join(t.files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path")), "source_file_id").select("target_file_id", "source_path")


@q("tests_covering__J20", f"with {_EDGES} select target_file_id, source_file_id from edges e join files f on f.id = e.source_file_id where f.is_test")
def tests_covering(t):
    return _edges(t).join(t.files.where("is_test").select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").select("target_file_id", "source_file_id")


@q("indegrees__A7", f"with {_EDGES} select * from degree")
def indegrees(t):
    return graph.indegrees(_edges(t))


@q("promoted_tiers__S4", f"with {_EDGES} select f.id, case when index_tier = 'support' and coalesce(dependents, 0) >= 4 then 'core' else index_tier end as tier from files f left join degree d on d.file_id = f.id and d.project_id = f.project_id")
def promoted_tiers(t):
    degree = graph.indegrees(_edges(t)).withColumnRenamed("file_id", "id")
    return t.files.join(degree, ["project_id", "id"], "left").select("id", paths.promoted(F.col("index_tier"), F.col("dependents")).alias("tier"))


@q("hubs__G2", f"with {_EDGES} select f.project_id, path, dependents from degree d join files f on f.id = d.file_id order by dependents desc, path, f.project_id limit 20")
def hubs(t):
    degree = graph.indegrees(_edges(t)).select(F.col("file_id").alias("id"), "dependents")
    return degree.join(t.files.select("id", "project_id", "path"), "id").select("project_id", "path", "dependents").orderBy(F.desc("dependents"), "path", "project_id").limit(20)


@q("two_cycles__G3", f"with {_EDGES} select a.project_id, a.source_file_id as a, a.target_file_id as b from edges a join edges b on a.source_file_id = b.target_file_id and a.target_file_id = b.source_file_id where a.source_file_id < a.target_file_id")
def two_cycles(t):
    return graph.two_cycles(_edges(t))


@q("callers_of__G4", f"with {_CALLS} select file_id, line from calls where name in (select min(name) from calls)")
def callers_of(t):
    calls = _calls(t)
    return calls.join(calls.agg(F.min("name").alias("name")), "name", "left_semi").select("file_id", "line")


_EXT = r"(?:extends|implements)\s+([A-Za-z_]\w*)"


@q("hierarchy__G5", rf"select distinct s.project_id, s.name, b.base, d.id is not null as known from (select distinct project_id, name, unnest(regexp_extract_all(signature, '{_EXT}', 1)) as base from symbols where kind = 'class') b join symbols s on s.project_id = b.project_id and s.name = b.name and s.kind = 'class' left join (select project_id, name, min(id) as id from symbols where kind in ('class', 'interface') group by 1, 2) d on d.project_id = b.project_id and d.name = b.base")
def hierarchy(t):
    """Base classes and interfaces of each class, and whether the project defines them."""
    named = t.symbols.where("kind = 'class'").select("project_id", "name", F.explode(F.regexp_extract_all("signature", F.lit(_EXT), F.lit(1))).alias("base")).distinct()
    bases = t.symbols.where("kind in ('class', 'interface')").select("project_id", F.col("name").alias("base"), F.lit(True).alias("hit")).distinct()
    return named.join(bases, ["project_id", "base"], "left").select("project_id", "name", "base", F.coalesce("hit", F.lit(False)).alias("known"))


@q("children_count__J7", "select project_id, parent, count(distinct id) as members from symbols where parent is not null and kind = 'method' group by 1, 2")
def children_count(t):
    return t.symbols.where("parent is not null and kind = 'method'").groupBy("project_id", "parent").agg(F.countDistinct("id").alias("members"))


@q("traced__G6", f"""with recursive {_EDGES}, seeds as (select file_id as seed from degree order by dependents desc, file_id limit 10),
walk(seed, node, depth) as (select seed, seed, 0 from seeds union select w.seed, e.source_file_id, w.depth + 1 from walk w join edges e on e.target_file_id = w.node where w.depth < 3)
select seed, node, cast(min(depth) as int) as depth from walk where node <> seed group by 1, 2""")
def traced(t):
    """Files that reach the ten largest hubs within three steps, with their least distance."""
    edges = _edges(t)
    seeds = graph.indegrees(edges).orderBy(F.desc("dependents"), "file_id").limit(10).select(F.col("file_id").alias("seed"))
    return graph.reach(edges, seeds, 3)


@q("expanded__R6", f"""with {_EDGES}, primary_ as (select id as file_id, row_number() over (order by size desc, id) as rank from files qualify rank <= 40),
near as (select p.file_id, rank, other from (select distinct * from (select source_file_id as file_id, target_file_id as other from edges union all select target_file_id, source_file_id from edges)) b join primary_ p using (file_id) where rank <= 5 qualify row_number() over (partition by p.file_id order by other) <= 10),
found as (select other as file_id, count(*) as hits, min(rank) as best_seed from near where other not in (select file_id from primary_) group by 1)
select file_id, hits, cast(best_seed as int) as best_seed, round(1.0 / (60 + row_number() over (order by hits desc, best_seed, file_id)), 9) as score from found order by hits desc, best_seed, file_id limit 20""")
def expanded(t):
    top = t.files.orderBy(F.desc("size"), "id").limit(40).select(F.col("id").alias("file_id"), F.row_number().over(Window.orderBy(F.desc("size"), "id")).alias("rank"))
    return graph.expanded(top, _edges(t)).withColumn("score", F.round("score", 9))


@q("class_members__G8", "select distinct id, name from symbols where parent = (select min(parent) from symbols)")
def class_members(t):
    rows = t.symbols.select("id", "name", "parent")
    return rows.join(rows.agg(F.min("parent").alias("parent")), "parent", "left_semi").select("id", "name").distinct()


@q("symbol_tree__G9", """
with s as (select distinct file_id, id, name, kind, parent, line from symbols),
top as (select file_id, name, min(id) as id from s where parent is null group by 1, 2)
select s.file_id, s.id, top.id as parent_id, cast(row_number() over (partition by s.file_id order by s.line, s.id) as int) as ord from s left join top on top.file_id = s.file_id and top.name = s.parent""")
def symbol_tree(t):
    """Symbols of each file in line order beneath their parent."""
    s = t.symbols.select("file_id", "id", "name", "kind", "parent", "line").distinct()
    top = s.where("parent is null").groupBy("file_id", F.col("name").alias("parent")).agg(F.min("id").alias("parent_id"))
    return s.join(top, ["file_id", "parent"], "left").select("file_id", "id", "parent_id", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "id")).alias("ord"))


_IMPORTS = r"""with i as (select distinct f.id as file_id, f.project_id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as d, unnest(list_distinct(regexp_extract_all(content, 'from\s+[''"](\.[^''"\n]+)[''"]', 1))) as import_path
from files f join file_contents c on c.file_id = f.id where regexp_matches(path, '\.m?[jt]s$')),
b as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || d || '/' || import_path, '/\.(/|$)', '/', 'g'), '/[^/]+/\.\./', '/'), '/[^/]+/\.\./', '/'), '/[^/]+/\.\./', '/'), '^/', '') as base from i),
t as (select b.*, n, regexp_replace(base, '\.(js|mjs|cjs)$', '') || s as tried from b, (values (0, '.ts'), (1, '.tsx'), (2, '.mts'), (3, '.cts'), (4, '.js'), (5, '.jsx'), (6, ''), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js'), (10, '/index.jsx')) v(n, s))
select t.project_id, t.file_id, import_path, min_by(f.id, n) as target_file_id from t left join files f on f.project_id = t.project_id and f.path = tried group by 1, 2, 3"""


@q("resolved_imports__J16", _IMPORTS)
def resolved_imports(t):
    """Relative script imports resolved against the files of the project; those without a file stay null."""
    scripts = t.files.where(F.col("path").rlike(r"\.m?[jt]s$")).select(F.col("id").alias("file_id"), "project_id", paths.dirname(F.col("path")).alias("directory"))
    found = t.file_contents.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"from\s+['\"](\.[^'\"\n]+)['\"]"), F.lit(1)))).alias("import_path"))
    return graph.resolved_imports(scripts.join(found, "file_id"), t.files)


@q("file_scores__A14", f"""with {_EDGES}, s as (select file_id, least(count(distinct id), 10) as n from symbols where kind in ('function', 'class', 'interface', 'method', 'type') group by 1)
select f.id, cast(3 * coalesce(dependents, 0) + case when is_entry_point then 10 else 0 end + case complexity when 'very-high' then 5 when 'high' then 3 when 'medium' then 1 else 0 end + coalesce(n, 0) + case layer when 'business' then 2 when 'infrastructure' then 1 else 0 end as bigint) as score
from files f left join degree d on d.file_id = f.id and d.project_id = f.project_id left join s on s.file_id = f.id""")
def file_scores(t):
    degree = graph.indegrees(_edges(t)).withColumnRenamed("file_id", "id")
    rich = t.symbols.where(F.col("kind").isin("function", "class", "interface", "method", "type")).groupBy(F.col("file_id").alias("id")).agg(F.least(F.countDistinct("id"), F.lit(10)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    c, layer = F.col("complexity"), F.col("layer")
    score = 3 * zero("dependents") + F.when(F.col("is_entry_point"), 10).otherwise(0) + F.when(c == "very-high", 5).when(c == "high", 3).when(c == "medium", 1).otherwise(0) + zero("n") + F.when(layer == "business", 2).when(layer == "infrastructure", 1).otherwise(0)
    return t.files.join(degree, ["project_id", "id"], "left").join(rich, "id", "left").select("id", score.cast("bigint").alias("score"))


@q("directory_scores__A14b", f"""with {_EDGES} select project_id, dir, max(dependents) as best, count(*) as files from (select f.project_id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as dir, coalesce(dependents, 0) as dependents from files f left join degree d on d.file_id = f.id) group by 1, 2""")
def directory_scores(t):
    degree = graph.indegrees(_edges(t)).select(F.col("file_id").alias("id"), "dependents")
    return t.files.join(degree, "id", "left").groupBy("project_id", paths.dirname(F.col("path")).alias("dir")).agg(F.max(F.coalesce("dependents", F.lit(0))).alias("best"), F.count("*").alias("files"))


@q("architecture__A13", f"""with {_EDGES}, l as (select project_id, coalesce(layer, 'unknown') as layer, count(*) as n from files group by 1, 2),
h as (select project_id, max(dependents) as top_hub from degree group by 1), e as (select project_id, count(*) as entries from files where is_entry_point group by 1)
select l.project_id, l.layer, n, coalesce(entries, 0) as entries, coalesce(top_hub, 0) as top_hub from l left join h on h.project_id = l.project_id left join e on e.project_id = l.project_id""")
def architecture(t):
    layers = t.files.groupBy("project_id", F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"))
    entries = t.files.where("is_entry_point").groupBy("project_id").agg(F.count("*").alias("entries"))
    hub = graph.indegrees(_edges(t)).groupBy("project_id").agg(F.max("dependents").alias("top_hub"))
    return layers.join(entries, "project_id", "left").join(hub, "project_id", "left").select("project_id", "layer", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "top_hub")))


_DECLARED = (
    ("\\.py$", r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)"), ("\\.go$", r"^(func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    ("\\.java$", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)"),
    ("\\.(ts|mts|tsx|js|mjs|jsx)$", r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|type|const|let|var)\s*\*?\s+([A-Za-z_$][\w$]*)"),
)
_SKELETONS = "with l as (select file_id, path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from files join file_contents on file_id = id where supported) " + " union all ".join(
    f"select file_id, cast(line as int) as line, regexp_extract(text, '{p}', 1) as kind, regexp_extract(text, '{p}', 2) as name from l where regexp_matches(path, '{e}') and regexp_matches(text, '{p}')" for e, p in ((x.replace("\\\\", "\\"), y) for x, y in _DECLARED))


@q("skeletons__U3", _SKELETONS)
def skeletons(t):
    """Declarations found in texts by a Python table function: file, line, kind, name."""
    return skeleton.skeletons(t.files, t.file_contents)


@q("bodies__U3b", """select distinct s.id as symbol_id, cast(end_line - line + 1 as int) as lines, sha256(rtrim(array_to_string(string_split(content, chr(10))[line:end_line], chr(10)), chr(13))) as hash
from symbols s join file_contents c on c.file_id = s.file_id where kind in ('function', 'method') and content is not null and line > 0""")
def bodies(t):
    """The body of every function symbol: from its line to where its block ends."""
    return skeleton.bodies(t.symbols, t.file_contents)


_KNOWN = "known as (select distinct s.file_id, s.id, s.name, s.kind, s.parent, s.line, s.end_line from symbols s join file_contents c on c.file_id = s.file_id where c.supported and s.line is not null)"


@q("parsed_symbols__S6", f"with {_KNOWN} select file_id, kind, count(*) as symbols, cast(sum(end_line - line + 1) as bigint) as lines from known group by 1, 2")
def parsed_symbols(t):
    """Symbols that the walk finds in the texts of supported files where the index has one: per file and kind, with the lines they span."""
    known = t.symbols.select("file_id", "id", "name", "kind", "line", "end_line").distinct()
    found = symbols.parsed(t.files, t.file_contents).select("file_id", "name", "kind", "line", "end_line").distinct()
    both = known.join(found, ["file_id", "name", "kind", "line", "end_line"])
    return both.groupBy("file_id", "kind").agg(F.count("*").alias("symbols"), F.sum(F.col("end_line") - F.col("line") + 1).alias("lines"))


@q("class_members__S7", f"with {_KNOWN} select distinct file_id, parent, name, line from known where kind = 'method'")
def parsed_members(t):
    """Members of classes, found by walking into class bodies only, where the index has them."""
    known = t.symbols.where("kind = 'method'").select("file_id", "parent", "name", "line").distinct()
    found = symbols.parsed(t.files, t.file_contents).where("kind = 'method'").select("file_id", "parent", "name", "line").distinct()
    return known.join(found, ["file_id", "parent", "name", "line"])


@q("reduced_texts__D8")
def reduced_texts(t):
    """Documents reduced to 800 characters by the reducer of command output."""
    return reducers.reduced(t.documents, "doc_id", "text", "run_command", 800)


@q("crushed_events__D1")
def crushed_events(t):
    """Events of a kind as JSON lines, at most 500 a payload by blocks of ids, crushed to 1,000 characters."""
    block = F.concat_ws("/", F.floor(F.col("event_id") / 500), "event_type")
    lines = t.events.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.to_json(F.struct("user_id", "value")).alias("j")))).alias("l"))
    return reducers.reduced(lines.select("block", F.array_join(F.transform("l", lambda x: x["j"]), "\n").alias("text")), "block", "text", "json", 1000)


_LOG_SQL = r"""
select user_id, cast(island as bigint) as island, any_value(event_type) as event_type, count(*) as run from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as island from (select user_id, event_id, ts, event_type, case when event_type is not distinct from lag(event_type) over w and lag(1) over w is not null then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id))) group by user_id, island having count(*) > 1"""


@q("log_runs__D7", _LOG_SQL)
def log_runs(t):
    """Runs of equal neighbouring log lines, as the log reducer collapses them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    numbered = t.events.select("user_id", "event_id", "ts", "event_type").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return numbered.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("run")).where("run > 1")
