"""Directories as tables, and the incremental index run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import paths, texts
from lodestrand.operators.merge import classified
from lodestrand.streaming.changes import guarded

FILES = "path string, size bigint, mtime_ms bigint, content string, content_hash string, line_count bigint, language string, index_tier string"


def scanned(spark: SparkSession, root: str, ignore: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """FILES below root by the binaryFile source; paths are relative, ignored and hard-excluded ones never leave the scan's filter."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    relative = F.substring(path, len(root.rstrip("/")) + 2, 1_000_000)
    listed = reader.load(root).select(relative.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    p = F.col("path")
    kept = listed.where(~paths.hard_excluded(p) & ~paths.binary_name(p) & ~paths.ignored(p, ignore or []))
    text = kept.withColumn("content", F.decode("content", "UTF-8"))
    return text.where(texts.indexable(F.col("content")) | (F.col("content") == "")).select(
        "path", "size", "mtime_ms", "content", texts.content_hash(F.col("content")).alias("content_hash"), texts.line_count(F.col("content")).cast("bigint").alias("line_count"), paths.language_id(p).alias("language"), paths.index_tier(p, F.col("size")).alias("index_tier"))


def index_run(known: DataFrame, now: DataFrame, most: int | None = 200_000) -> dict:
    """One incremental run: verdict ok, too_large or empty_scan, and the classified paths (path, kind) where it is ok; no number is too large where most is None."""
    found = now.count()
    verdict = guarded(found, known.count(), found if most is None else most)
    return {"verdict": verdict, "changes": classified(known, now, ["path"], "content_hash") if verdict == "ok" else None}
