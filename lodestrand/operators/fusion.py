"""Fusion, selection and budgets over ranked lists. Order is data: every list carries its ranks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut


def rrf(lists: DataFrame, k: int = 60, limit: int | None = None, by: str | None = None) -> DataFrame:
    """(candidate, score, rank) from lists (source_ord, candidate, rank [, by]): sum of 1 / (k + rank).

    A candidate that stands twice in one list counts twice; ties keep the order of first appearance.
    """
    keys = [by] if by else []
    fused = lists.groupBy(*keys, "candidate").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("source_ord", "rank")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 12)), "first", "candidate")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select(*keys, "candidate", "score", "rank")


def top_k(df: DataFrame, score: str, order: str, k: float, by: list[str] | None = None) -> DataFrame:
    """The k highest, ties by order; an infinite k keeps all, a negative one none. Per group the plan keeps k rows a task before shuffling."""
    if k == float("inf"):
        return df
    k = max(0, int(k))
    if not by:
        return df.orderBy(F.desc(score), F.asc(order)).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def diverse(df: DataFrame, query: str, group: str, score: str, order: str, k: int, attenuation: float = 0.5) -> DataFrame:
    """Greedy diversity as windows: the n-th pick of a group counts attenuation^(n-1) of its score.

    Equal to the greedy loop for scores >= 0 and 0 <= attenuation <= 1; anything else is refused.
    """
    if not 0 <= attenuation <= 1:
        raise ValueError("attenuation must lie within 0 and 1")
    within = Window.partitionBy(query, group).orderBy(F.desc(score), F.asc(order))
    checked = F.when(F.col(score) < 0, F.raise_error(F.lit("negative score")).cast("double")).otherwise(F.col(score))
    eff = df.withColumn("effective", checked * F.pow(F.lit(float(attenuation)), F.row_number().over(within) - 1))
    overall = Window.partitionBy(query).orderBy(F.desc("effective"), F.asc(order))
    return eff.withColumn("slot", F.row_number().over(overall)).where(F.col("slot") <= k)


def blended(df: DataFrame, query: str, total: int, spacing: dict[str, int] | int | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """(query, slot, track, candidate): tracks (track_ord, track, pos, candidate) merged slot by slot, least used first.

    A track waits until its spacing since its last slot has passed; where every track that is left
    waits, the list ends. Sequential per query; a query's tracks are short lists.
    """
    caps = caps or {}
    gap = spacing if isinstance(spacing, int) else 1  # of every track that spacing doesn't name
    named = spacing if isinstance(spacing, dict) else {}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tracks = [(t, list(g.sort_values("pos")["candidate"])) for (_, t), g in rows.groupby(["track_ord", "track"], sort=True)]
        used = {t: 0 for t, _ in tracks}
        last = {t: -(1 << 60) for t, _ in tracks}
        out = []
        for slot in range(total):
            open_tracks = [(used[t], n, t) for n, (t, items) in enumerate(tracks) if used[t] < min(len(items), caps.get(t, len(items))) and slot - last[t] >= named.get(t, gap)]
            if not open_tracks:
                break
            _, n, t = min(open_tracks)
            out.append((rows[query].iloc[0], slot, t, tracks[n][1][used[t]]))
            used[t] += 1
            last[t] = slot
        return pd.DataFrame(out, columns=[query, "slot", "track", "candidate"])

    kinds = dict(df.dtypes)
    return df.groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, slot int, track string, candidate {kinds['candidate']}")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def capped_per_group(df: DataFrame, group: list[str], order: list[str], cap: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def within_budget(df: DataFrame, size: str, group: list[str], order: list[str], budget: int) -> DataFrame:
    """The leading rows of each group whose sizes, one separator each, fit the budget; it ends at the first that doesn't."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.col(size) + 1).over(w)).where(F.col("used") <= budget)


def islands(df: DataFrame, value: str, group: list[str], order: list[str]) -> DataFrame:
    """Runs of equal neighbouring values: (group..., value, first, last, run)."""
    w = Window.partitionBy(*group).orderBy(*order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    numbered = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("run")).drop("_island")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's 1-based place within its group, for groups too large to sort in one task.

    Rows are cut into ranges of group and order; places within a range are counted from the sizes of
    the group's ranges before it. order must tell any two rows of a group apart. No task sees more of a
    hot group than its range; the ranges' sizes are one row a group and range.
    """
    held = cut(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    joined = held.alias("h").join(starts.alias("s"), [F.col("h._part") == F.col("s._part"), *keys]).select("h.*", "s._before")
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    return joined.withColumn(name, (F.col("_before") + F.row_number().over(within)).cast("bigint")).drop("_part", "_before")
