"""Incremental writes as set algebra over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(old: DataFrame, new: DataFrame, key: list[str], state: str) -> DataFrame:
    """(key..., kind): added, removed, modified or unchanged, in one full outer join."""
    a = old.select(*key, F.col(state).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*key, F.col(state).alias("_new"), F.lit(True).alias("_is"))
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(*key, kind.alias("kind"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """new over old by key; columns in keep_old take the old value where the new one is null. Applying it twice changes nothing."""
    keep_old = keep_old or []
    values = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in values), F.lit(True).alias("_hit"))
    both = old.join(fresh, key, "full")
    pick = lambda c: (F.when(F.col("_hit") & ~(F.col(f"_n_{c}").isNull() & F.lit(c in keep_old)), F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c)
    return both.select(*key, *(pick(c) for c in values))


def children_replaced(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of parents that new mentions come from new."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def counted_upsert(queue: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """Retry queue: attempts + 1 for known keys, 1 for new ones."""
    more = failed.select(*key).distinct().withColumn("_more", F.lit(1))
    both = queue.select(*key, "attempts").join(more, key, "full")
    return both.select(*key, (F.coalesce("attempts", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("attempts"))


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def beyond(df: DataFrame, key: list[str], order: list[str], keep: int) -> DataFrame:
    """The rows of each key behind its newest keep, which pruning deletes."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > keep).drop("_rn")


def changed_revisions(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Revisions that differ from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumns({"_before": F.lag(state).over(w), "_rn": F.row_number().over(w)})
    return numbered.where(~F.col(state).eqNullSafe(F.col("_before")) | (F.col("_rn") == 1)).drop("_before", "_rn")


def versioned(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Version numbers and validity spans: (.., version, valid_from, valid_to)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumns({"version": F.row_number().over(w), "valid_from": F.col(order[0]), "valid_to": F.lead(order[0]).over(w)})


def refcounts(links: DataFrame, blob: str) -> DataFrame:
    return links.groupBy(blob).agg(F.count("*").alias("refcount"))


def orphans(registered: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    return registered.join(live, key, "left_anti")


def parity(parts: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, tuple[int, int]]:
    """Row counts of source and copy of each table; a split may go on where they agree."""
    return {name: (a.count(), b.count()) for name, (a, b) in parts.items()}
