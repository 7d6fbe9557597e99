"""Small keyed records (costs, runs of explorers, checkpoints, webhooks, providers) as versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.merge import upserted
from lodestrand.sources.versions import VersionedTable


class Records:
    """Insert, update, delete and list rows of one schema by key; rows without a key of their own (costs) are told apart by all columns and a number."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.key, self.held = key, VersionedTable(spark, path, schema, key)

    def insert(self, rows: DataFrame) -> None:
        """Add rows; keys that are there already stay as they are."""
        def added(old: DataFrame) -> DataFrame:
            return old.unionByName(rows.dropDuplicates(self.key).join(old.select(*self.key), self.key, "left_anti").select(*old.columns))

        self.held.rewrite(added, self.held.touched_by(rows))

    def append(self, rows: DataFrame) -> None:
        """Add rows to a log, repeats included."""
        self.held.rewrite(lambda old: old.unionByName(rows.select(*old.columns)), self.held.touched_by(rows))

    def upsert(self, rows: DataFrame, keep_old: list[str] | None = None) -> None:
        """Put rows in the place of those with their key; columns in keep_old stay where the new value is null."""
        self.held.rewrite(lambda old: upserted(old, rows.dropDuplicates(self.key).select(*old.columns), self.key, keep_old).select(*old.columns), self.held.touched_by(rows))

    def delete(self, keys: DataFrame) -> None:
        self.held.rewrite(lambda old: old.join(keys.select(*self.key), self.key, "left_anti").select(*old.columns), self.held.touched_by(keys))

    def list(self, where: Column | None = None) -> DataFrame:
        return self.held.read() if where is None else self.held.read().where(where)

    def one(self, **key) -> DataFrame:
        rows = self.held.read()
        for name, value in key.items():
            rows = rows.where(F.col(name).eqNullSafe(value))
        return rows
