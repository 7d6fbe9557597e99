"""Live refresh: file-change events, debounced batches, touch state and windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrand.functions import scores
from lodestrand.operators.merge import latest
from lodestrand.sources.versions import VersionedTable

EVENTS = "project_id bigint, path string, kind string, is_dir boolean, seq bigint, ts timestamp"


def change_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 200) -> DataFrame:
    """File-change events as JSON lines dropped into a folder; a trigger takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def debounced(events: DataFrame, key: list[str], at: str, gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Batches that end once a key is quiet for gap: (key..., started, ended, n). Rows later than the watermark are dropped."""
    batch = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(*key, batch.alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def windowed(events: DataFrame, key: list[str], at: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per key over tumbling or sliding event-time windows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(*key, w.alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("started"), "n")


def coalesced(events: DataFrame) -> DataFrame:
    """The last event of each path, deletes before upserts: what a drained dirty queue holds."""
    last = latest(events.where("not coalesce(is_dir, false)"), ["project_id", "path"], "seq")
    return last.select("project_id", "path", "kind", "seq", F.when(F.col("kind") == "delete", 0).otherwise(1).alias("step"))


def touches(events: DataFrame, key: str, at: str, edited: str) -> DataFrame:
    """Running state of each key: last touch, number of touches, whether it was ever edited."""
    return events.groupBy(key).agg(F.max(at).alias("last"), F.count("*").alias("n"), F.bool_or(edited).alias("edited"))


def recent(state: DataFrame, key: list[str], owner: list[str], now: Column, half_life: float, most: int = 50) -> DataFrame:
    """The hot source: of the touches (owner..., key..., last, n, edited) of each owner the most latest, scored by recency and edits.

    half_life in seconds; ties by key. Per-owner top-k keeps most rows a task before any shuffle.
    """
    w = Window.partitionBy(*owner).orderBy(F.desc("last"), *key)
    held = state.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    age = F.greatest(F.lit(0.0), F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp")))
    return held.withColumn("score", scores.recent_file(scores.recency(age, half_life), F.lit(0), F.col("edited")))


def applied(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The indexed paths after a coalesced batch; applying it twice changes nothing."""
    gone = state.join(batch.select("project_id", "path"), ["project_id", "path"], "left_anti")
    return gone.unionByName(batch.where("kind = 'upsert'").select("project_id", "path", "seq"))


def guarded(found: int, known: int, most: int) -> str:
    """ok, too_large or empty_scan: whether a scan may replace what is indexed."""
    return "too_large" if found > most else "empty_scan" if found == 0 and known > 0 else "ok"


STATE = "project_id bigint, path string, seq bigint"


def refresh(events: DataFrame, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep a table of indexed paths current, one version a micro-batch.

    Batch n is coalesced and made version n of a VersionedTable: only the buckets it touches are
    written anew. It always starts from the newest version before n, so that a batch which is
    replayed, at whatever point the first try broke off, gives the same version again. One query per
    target (KeyedLocks serialises others).
    """

    def step(batch: DataFrame, number: int) -> None:
        held = VersionedTable(batch.sparkSession, target, STATE, ["project_id", "path"])
        changed = coalesced(batch).persist()
        held.rewrite(lambda state: applied(state, changed), held.touched_by(changed), number)
        if after:
            after(changed, number)
        changed.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table's last complete version; empty before the first."""
    return VersionedTable(spark, target, STATE, ["project_id", "path"]).read()
