"""Graph operators over edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

CALL = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
MOST_CALLS = 400
# Suffixes tried in this order for an import without one.
CANDIDATES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", "", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def call_sites(contents: DataFrame, names: DataFrame, most: int | None = MOST_CALLS) -> DataFrame:
    """(project_id, file_id, name, line): identifiers before a parenthesis that names (project_id, name) knows, once a line, the first most of a file; all of them where most is None."""
    lines = contents.where("content is not null").select("project_id", "file_id", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    called = lines.where(F.col("text").contains("(")).select("project_id", "file_id", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))).alias("name"))
    known = called.join(names.select("project_id", "name").distinct(), ["project_id", "name"], "left_semi")
    if most is None:
        return known.select("project_id", "file_id", "name", "line")
    w = Window.partitionBy("file_id").orderBy("line", "name")
    return known.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select("project_id", "file_id", "name", "line")


def reference_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, source_file_id, target_file_id): file calls a name whose first symbol another file of the project defines."""
    first = symbols.groupBy("project_id", "name").agg(F.min_by("file_id", "id").alias("target_file_id"))
    return calls.join(first, ["project_id", "name"]).where("file_id <> target_file_id").select("project_id", F.col("file_id").alias("source_file_id"), "target_file_id").distinct()


def indegrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id", F.col("target_file_id").alias("file_id")).agg(F.count("*").alias("dependents"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """(project_id, a, b), a < b: files that depend on each other."""
    back = edges.select("project_id", F.col("target_file_id").alias("a"), F.col("source_file_id").alias("b"))
    return edges.select("project_id", F.col("source_file_id").alias("a"), F.col("target_file_id").alias("b")).where("a < b").join(back, ["project_id", "a", "b"], "left_semi").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node, depth): nodes within depth steps against the edges, each with its least depth.

    Frontiers are joined with the edges and stripped of what is known, so work follows the frontier;
    lineage is cut once a step.
    """
    back = cut(edges.select(F.col("target_file_id").alias("node"), F.col("source_file_id").alias("to")).distinct())
    known = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = known
    for d in range(1, depth + 1):
        frontier = cut(frontier.join(back, "node").select("seed", F.col("to").alias("node")).distinct().join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        known = known.union(frontier)
    return known.where("depth > 0")


def expanded(primary: DataFrame, edges: DataFrame, seeds: int = 5, neighbours: int = 10, limit: int = 20) -> DataFrame:
    """(file_id, hits, best_seed, score): neighbours of the best seeds of primary (file_id, rank), by how many seeds reach them."""
    both = edges.select(F.col("source_file_id").alias("file_id"), F.col("target_file_id").alias("other")).union(edges.select(F.col("target_file_id").alias("file_id"), F.col("source_file_id").alias("other"))).distinct()
    near = primary.where(F.col("rank") <= seeds).join(both, "file_id")
    near = near.withColumn("_rn", F.row_number().over(Window.partitionBy("file_id").orderBy("other"))).where(F.col("_rn") <= neighbours)
    fresh = near.select(F.col("other").alias("node"), "rank").join(primary.select(F.col("file_id").alias("node")), "node", "left_anti")
    found = fresh.groupBy("node").agg(F.count("*").alias("hits"), F.min("rank").alias("best_seed"))
    order = (F.desc("hits"), F.asc("best_seed"), F.asc("node"))
    top = found.orderBy(*order).limit(limit)
    return top.select(F.col("node").alias("file_id"), "hits", "best_seed", (1 / (60.0 + F.row_number().over(Window.orderBy(*order)))).alias("score"))


def folded(directory: Column, relative: Column) -> Column:
    """A relative import path against a directory, dots folded."""
    parts = F.concat(F.filter(F.split(directory, "/"), lambda x: x != ""), F.filter(F.split(relative, "/"), lambda x: (x != "") & (x != ".")))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.array_join(stack, "/")


def resolved_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(project_id, file_id, import_path, target_file_id): imports at the first candidate that exists, null where none does.

    imports: project_id, file_id, directory, import_path. Relative paths are folded against the
    directory; other paths go through aliases (project_id, prefix, target), the longest prefix first:
    what follows the prefix is looked for below target. Candidates are exploded with their order and met by one equi-join.
    """
    own = imports.select("project_id", "file_id", "directory", "import_path").distinct()
    bases = own.where(F.col("import_path").startswith(".")).select("project_id", "file_id", "import_path", folded(F.col("directory"), F.col("import_path")).alias("base"), F.lit(0).alias("way"))
    if aliases is not None:
        named = own.where(~F.col("import_path").startswith(".")).join(aliases, "project_id").where(F.col("import_path").startswith(F.col("prefix")))
        rest = F.substring("import_path", F.length("prefix") + 1, F.length("import_path"))
        bases = bases.union(named.select("project_id", "file_id", "import_path", folded(F.col("target"), rest), -F.length("prefix")))
    bases = bases.withColumn("base", F.regexp_replace("base", r"\.(js|mjs|cjs)$", ""))
    tried = bases.select("project_id", "file_id", "import_path", "way", F.posexplode(F.array(*(F.concat("base", F.lit(c)) for c in CANDIDATES))).alias("priority", "path"))
    known = files.select("project_id", "path", F.col("id").alias("target"))
    hits = tried.join(known, ["project_id", "path"]).groupBy("project_id", "file_id", "import_path").agg(F.min_by("target", F.struct("way", "priority")).alias("target_file_id"))
    return own.select("project_id", "file_id", "import_path").distinct().join(hits, ["project_id", "file_id", "import_path"], "left")


@dataclass
class StoredEdges:
    """Edges (project_id, source_file_id, target_file_id) in a folder by project, so that a project's queries read its edges only and nothing is derived from texts again."""

    spark: SparkSession
    folder: str

    def replace(self, edges: DataFrame) -> None:
        """Put the edges of the projects that edges has in the place of theirs; other projects stay. Doing so again changes nothing."""
        held = edges.select("source_file_id", "target_file_id", "project_id").distinct()
        held.repartition(F.col("project_id"), F.pmod(F.xxhash64("source_file_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(self.folder)

    def read(self, project: int | None = None) -> DataFrame:
        rows = self.spark.read.schema("source_file_id bigint, target_file_id bigint, project_id bigint").parquet(self.folder).select("project_id", "source_file_id", "target_file_id")
        return rows if project is None else rows.where(F.col("project_id") == project)
