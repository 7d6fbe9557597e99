"""Rolling totals over trailing periods, quiet days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """One row per entity and calendar day with activity: n_rows, n_values, total.

    Rows without entity or time belong to no day and are left out. A null or NaN value counts
    as a row without value. Partial aggregation on the map side makes a hot entity cheap: at
    most one row per entity, day and task is shuffled.
    """
    amount = F.col(value).cast("double")
    amount = F.when(F.isnan(amount), None).otherwise(amount)
    return (
        df.select(F.col(entity).alias("entity"), F.to_date(at).alias("day"), amount.alias("amount"))
        .where("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(F.count("*").alias("n_rows"), F.count("amount").alias("n_values"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    )


def densify(daily: DataFrame) -> DataFrame:
    """Every calendar day of every entity from its first to its last, quiet days with zeros.

    The calendar is generated per entity from its own bounds and joined back on (entity, day),
    which gives the rows of an entity-calendar cross join without one.
    """
    calendar = (
        daily.groupBy("entity")
        .agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
        .select("entity", F.explode(F.sequence("lo", "hi")).alias("day"))
    )
    return calendar.join(daily, ["entity", "day"], "left").select(
        "entity", "day", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n_rows", "bigint"), ("n_values", "bigint"), ("total", "double")))
    )


def rolling_totals(df: DataFrame, entity: str, at: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Per entity and day the totals and averages over the trailing periods.

    For each period p (the day and the p-1 before): rows_p, total_p, avg_p (per row that has a
    value; null without one) and day_avg_p (per calendar day of the period since the entity's
    first day). Window partitions hold days, never input rows, so a hot entity stays small.
    Empty input gives no rows; repeated rows count as often as they occur.
    """
    dense = densify(daily_totals(df, entity, at, value))
    out = dense
    for p in periods:
        w = Window.partitionBy("entity").orderBy("day").rowsBetween(1 - p, 0)
        out = out.withColumns({
            f"rows_{p}": F.sum("n_rows").over(w),
            f"total_{p}": F.sum("total").over(w),
            f"avg_{p}": F.when(F.sum("n_values").over(w) > 0, F.sum("total").over(w) / F.sum("n_values").over(w)),
            f"day_avg_{p}": F.sum("total").over(w) / F.count("*").over(w),
        })
    return out.withColumnRenamed("entity", entity)
