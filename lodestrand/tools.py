"""The tool surface: one Python function per question, each a DataFrame over the index tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import paths, vectors
from lodestrand.operators import fusion, graph, planner, postings, search
from lodestrand.plans.registry import Tables
from lodestrand.sources import skeleton, stores

TOOLS: dict[str, Callable[..., DataFrame]] = {}
CORE = ("list_projects", "get_project_stats", "search", "search_by_kind", "grep_code", "get_file_structure", "read_file", "list_directory", "get_dependencies", "get_dependents", "find_references", "get_symbol_details", "get_repo_map")


def tool(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[build.__name__] = build
    return build


def call(spark, folder: str, which: str, surface: str = "full", /, **arguments) -> DataFrame:
    """Run a tool of the surface (core or full) over a folder of tables."""
    if which not in TOOLS or (surface == "core" and which not in CORE):
        raise ValueError(f"no tool {which} on the {surface} surface")
    return TOOLS[which](Tables(spark, folder), **arguments)


def _edges(t) -> DataFrame:
    return graph.reference_edges(graph.call_sites(t.file_contents, t.symbols), t.symbols)


@tool
def list_projects(t):
    return t.projects.join(t.files.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("files")), "id", "left").select("id", "name", "root_path", F.coalesce("files", F.lit(0)).alias("files"))


@tool
def get_project_stats(t, project: int):
    return t.files.where(F.col("project_id") == project).groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("line_count").alias("lines"))


@tool
def get_project_overview(t, project: int):
    return t.files.where((F.col("project_id") == project) & F.col("summary").isNotNull()).orderBy(F.desc("is_entry_point"), "path").limit(50).select("path", "summary", "layer")


@tool
def get_project_pulse(t, project: int, k: int = 8):
    concepts = t.files.where(F.col("project_id") == project).select(F.explode("concepts").alias("c")).where(F.trim("c") != "")
    return concepts.groupBy(F.lower(F.trim("c")).alias("concept")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(k)


@tool
def get_architecture(t, project: int):
    own = t.files.where(F.col("project_id") == project)
    return own.groupBy(paths.layer(F.col("path"), F.col("layer")).alias("layer")).agg(F.count("*").alias("files"), F.count(F.when(F.col("is_entry_point"), 1)).alias("entries"))


@tool
def get_repo_map(t, project: int, budget: int = 2000):
    """Files by score within a budget of estimated tokens."""
    degree = graph.indegrees(_edges(t)).select(F.col("file_id").alias("id"), "dependents")
    own = t.files.where(F.col("project_id") == project).join(degree, "id", "left")
    scored = own.select("id", "path", (3 * F.coalesce("dependents", F.lit(0)) + F.when(F.col("is_entry_point"), 10).otherwise(0)).alias("score"), F.length("path").alias("n"), F.lit(1).alias("one"))
    return fusion.within_budget(scored.withColumn("order", -F.col("score")), "n", ["one"], ["order", "path", "id"], 4 * budget).select("path", "score")


def _stream(t, query: str, kind: str, project: int | None, limit: int, language: str | None = None) -> DataFrame:
    """(id, rank) from the stored index of files, symbols or contents; project and language keep hits before the limit."""
    rows, ident, text = {
        "files": lambda: (t.files, "id", F.concat_ws(" ", "path", "summary", F.array_join("concepts", " "))),
        "symbols": lambda: (t.symbols.dropDuplicates(["id"]), "id", F.concat_ws(" ", F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "signature", "comment")),
        "contents": lambda: (t.file_contents, "file_id", F.col("content")),
    }[kind]()
    kept = rows if project is None else rows.where(F.col("project_id") == project)
    if language and kind == "files":
        kept = kept.where(F.lower("language") == language.lower())
    scope = kept.select(F.col(ident).alias("id")) if project is not None or language and kind == "files" else None
    return postings.index_of(rows, ident, text, f"{t.sf_dir}/{kind}").search(query, "auto", limit, scope).select("id", "rank")


MODES = ("auto", "fts", "vector", "hybrid")


def _vector_stream(t, query: str, project: int | None, limit: int, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """The files and symbols whose vectors are nearest to the query's; a file or symbol with several vectors counts by its nearest."""
    asked = F.array(*(F.lit(float(x)) for x in (embed or stores.hash_embedding)(query)))
    kind = F.when(F.col("type").startswith("symbol"), "symbol:").when(F.col("type").startswith("file"), "file:")
    rows = t.vectors.where(F.size("embedding") == F.size(asked)).where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: ~F.isnan(x)))
    if project is not None:
        rows = rows.join(t.projects.where(F.col("id") == project).select(F.col("name").alias("project_name")), "project_name", "left_semi")
    near = rows.select(F.concat(kind, "ref_id").alias("candidate"), vectors.l2(F.col("embedding"), asked).alias("d")).where("candidate is not null and not isnan(d)")
    top = near.groupBy("candidate").agg(F.min("d").alias("d")).orderBy("d", "candidate").limit(limit)
    return top.select("candidate", F.row_number().over(Window.orderBy("d", "candidate")).alias("rank"))


@tool
def search_(t, query: str, project: int | None = None, mode: str = "auto", limit: int = 20, language: str | None = None, embed: Callable[[str], list[float]] | None = None, imagine: Callable[[str], str] | None = None):
    """Ranked hits of files, symbols and contents: fts fuses word streams, vector the nearest vectors, hybrid both, each for all variants of the query; auto lets the planner choose.

    embed makes the query's vector, of the stored vectors' dimension. imagine writes an answer that is
    embedded beside the query.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    chosen = planner.plan(query)[0] if mode == "auto" else mode
    asked = [query] if chosen == "fts" else planner.variants(query)
    streams = []
    for one in asked:
        if chosen != "vector":
            streams += [_stream(t, one, kind, project, 3 * limit, language).select(F.concat(F.lit("symbol:" if kind == "symbols" else "file:"), "id").alias("candidate"), "rank") for kind in ("files", "symbols", "contents")]
        if chosen != "fts":
            streams.append(_vector_stream(t, one, project, 3 * limit, embed))
    imagined = planner.hypothetical(query, imagine) if chosen != "fts" else None
    if imagined:
        streams.append(_vector_stream(t, imagined, project, 3 * limit, embed))
    lists = None
    for n, stream in enumerate(streams):
        part = stream.select(F.lit(n).alias("source_ord"), "candidate", "rank")
        lists = part if lists is None else lists.union(part)
    return fusion.rrf(lists, limit=limit).orderBy("rank")


TOOLS["search"] = TOOLS.pop("search_")


@tool
def search_global(t, query: str, per_project: int = 5, limit: int = 20):
    hits = _stream(t, query, "files", None, 50 * limit).join(t.files.select("id", "project_id", "path"), "id")
    w = Window.partitionBy("project_id").orderBy("rank")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_project).orderBy("rank").limit(limit).select("project_id", "path", "rank")


@tool
def search_concepts(t, concept: str):
    return t.files.where(F.exists("concepts", lambda c: F.lower(F.trim(c)) == concept.strip().lower())).select("project_id", "path")


@tool
def search_by_kind(t, kind: str, project: int, limit: int = 100):
    return t.symbols.where((F.col("kind") == kind) & (F.col("project_id") == project)).select("id", "name", "file_path", "line").distinct().orderBy("name", "id").limit(limit)


@tool
def grep_code(t, pattern: str, literal: bool = False, case_sensitive: bool = True, language: str | None = None, glob: str | None = None, max_results: int = 50):
    files = t.files
    if language:
        files = files.where(F.lower("language") == language.lower())
    if glob:
        files = files.where(F.col("path").rlike(paths.glob_pattern(glob)))
    texts = t.file_contents.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return search.grep(texts, "path", "content", pattern, literal, case_sensitive, max_results)


@tool
def get_file_structure(t, file_id: int):
    return t.symbols.where(F.col("file_id") == file_id).select("id", "kind", "name", "parent", "line", "end_line").distinct().orderBy("line", "id")


@tool
def get_file_skeleton(t, file_id: int):
    return skeleton.skeletons(t.files.where(F.col("id") == file_id), t.file_contents).orderBy("line")


@tool
def read_file(t, file_id: int, first: int = 1, last: int = 1_000_000):
    lines = t.file_contents.where(F.col("file_id") == file_id).select(F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return lines.select((F.col("at") + 1).alias("line_no"), "line").where(F.col("line_no").between(first, last)).orderBy("line_no")


@tool
def list_directory(t, project: int, prefix: str = "", depth: int = 1, limit: int = 200):
    below = F.size(F.split(F.substring("path", len(prefix) + 1, 1_000_000), "/")) <= depth
    return t.files.where((F.col("project_id") == project) & F.col("path").startswith(prefix) & below).orderBy("path").limit(limit).select("path", "size")


@tool
def get_recently_modified_files(t, project: int, limit: int = 20):
    return t.files.where(F.col("project_id") == project).orderBy(F.desc("updated_at"), "id").limit(limit).select("path", "updated_at")


@tool
def get_dependencies(t, file_id: int):
    return _edges(t).where(F.col("source_file_id") == file_id).select("target_file_id")


@tool
def get_dependents(t, file_id: int):
    return _edges(t).where(F.col("target_file_id") == file_id).select("source_file_id")


@tool
def get_symbol_details(t, symbol_id: int):
    return t.symbols.where(F.col("id") == symbol_id).dropDuplicates(["id"])


@tool
def get_class_members(t, project: int, name: str):
    return t.symbols.where((F.col("project_id") == project) & (F.col("parent") == name)).select("id", "kind", "name", "line").distinct().orderBy("line", "id")


@tool
def find_references(t, project: int, name: str):
    return graph.call_sites(t.file_contents.where(F.col("project_id") == project), t.symbols.where(F.col("name") == name)).orderBy("file_id", "line")


@tool
def get_hierarchy(t, project: int, name: str):
    """Bases of a class and the classes that name it as theirs."""
    bases = t.symbols.where((F.col("project_id") == project) & (F.col("kind") == "class")).select("name", F.explode(F.regexp_extract_all("signature", F.lit(r"(?:extends|implements)\s+([A-Za-z_]\w*)"), F.lit(1))).alias("base")).distinct()
    return bases.where((F.col("name") == name) | (F.col("base") == name))


@tool
def find_implementations(t, project: int, name: str):
    return get_hierarchy(t, project, name).where(F.col("base") == name).select("name")


@tool
def trace_usage(t, file_id: int, depth: int = 3):
    return graph.reach(_edges(t), t.files.where(F.col("id") == file_id).select(F.col("id").alias("seed")), depth)


@tool
def get_symbol_body(t, symbol_id: int):
    return skeleton.bodies(t.symbols.where(F.col("id") == symbol_id), t.file_contents)


@tool
def prepare_edit(t, symbol_id: int):
    """A symbol's neighbours in its file, three on each side."""
    own = t.symbols.where(F.col("id") == symbol_id).select("file_id").distinct()
    near = t.symbols.join(own, "file_id", "left_semi").select("file_id", "id", "name", "kind", "line").distinct()
    at = near.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "id")))
    target = at.where(F.col("id") == symbol_id).select("file_id", F.col("rn").alias("target"))
    return at.join(target, "file_id").where(F.abs(F.col("rn") - F.col("target")) <= 3).select("id", "name", "kind", "line").orderBy("line", "id")


@tool
def semantic_neighbors(t, symbol_id: int, k: int = 5):
    """Symbols with the vectors nearest to a symbol's: bodies if it has one, else signatures."""
    from lodestrand.functions import vectors

    own = t.vectors.where((F.col("ref_id") == str(symbol_id)) & F.col("type").startswith("symbol") & (F.size("embedding") > 0)).orderBy(F.desc("type"), "vid").first()
    if own is None:
        return t.vectors.limit(0).select("vid", "ref_id", F.lit(0.0).alias("score"))
    asked = F.array(*(F.lit(float(x)) for x in own["embedding"]))
    others = t.vectors.where((F.col("type") == own["type"]) & (F.size("embedding") == len(own["embedding"])) & (F.col("ref_id") != str(symbol_id)))
    d = vectors.l2(F.col("embedding"), asked)
    return others.select("vid", "ref_id", d.alias("d")).distinct().orderBy("d", "vid").limit(k).select("vid", "ref_id", vectors.distance_score(F.col("d")).alias("score"))


@tool
def pack_context(t, query: str, project: int, limit: int = 3):
    """The declarations of the best files for a query."""
    top = _stream(t, query, "files", project, limit)
    return skeleton.skeletons(t.files.join(top, "id", "left_semi"), t.file_contents).join(top.withColumnRenamed("id", "file_id"), "file_id").orderBy("rank", "line")
