"""Queries of problem 1."""

from pyspark.sql import functions as F

from lodestrand.operators.rolling import rolling_totals
from lodestrand.session import table

NUDGE = 1e-11  # keeps averages that lie on a rounding limit on one side of it in every order of summing


def _rolled(spark, d):
    return rolling_totals(table(spark, d, "costs"), "project_id", "created_at", "cost_usd", (7, 30))


def p1_rolling(spark, d):
    r = _rolled(spark, d)
    return r.select(
        "project_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_rows",
        *(f"rows_{p}" for p in (7, 30)),
        *(F.round(F.col(f"{c}_{p}") + NUDGE, 6).alias(f"{c}_{p}") for p in (7, 30) for c in ("total", "avg", "day_avg")),
    )


def p1_found(spark, d):
    r = _rolled(spark, d)
    return r.where("rows_7 = 0 and rows_30 > 0").select("project_id", F.date_format("day", "yyyy-MM-dd").alias("day")).distinct()


QUERIES = {"p1_found": p1_found, "p1_rolling": p1_rolling}

_DENSE = """
with daily as (
  select project_id, cast(created_at as date) as day, count(*) as n_rows,
         count(case when not isnan(cost_usd) then cost_usd end) as n_values,
         coalesce(sum(case when not isnan(cost_usd) then cost_usd end), 0) as total
  from costs where project_id is not null and created_at is not null group by 1, 2),
span as (select project_id, min(day) as lo, max(day) as hi from daily group by 1),
cal as (select project_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from span),
dense as (
  select cal.project_id, cal.day, coalesce(n_rows, 0) as n_rows, coalesce(n_values, 0) as n_values, coalesce(total, 0.0) as total
  from cal left join daily on daily.project_id = cal.project_id and daily.day = cal.day),
rolled as (
  select project_id, day, n_rows, {cols}
  from dense
  window w7 as (partition by project_id order by day rows between 6 preceding and current row),
         w30 as (partition by project_id order by day rows between 29 preceding and current row))
"""
_COLS = ", ".join(
    f"sum(n_rows) over w{p} as rows_{p}, sum(total) over w{p} as total_{p}, "
    f"case when sum(n_values) over w{p} > 0 then sum(total) over w{p} / sum(n_values) over w{p} end as avg_{p}, "
    f"sum(total) over w{p} / count(*) over w{p} as day_avg_{p}"
    for p in (7, 30)
)
_CTE = _DENSE.format(cols=_COLS)
SQL = {
    "p1_found": _CTE + "select distinct project_id, strftime(day, '%Y-%m-%d') as day from rolled where rows_7 = 0 and rows_30 > 0",
    "p1_rolling": _CTE + "select project_id, strftime(day, '%Y-%m-%d') as day, cast(n_rows as bigint) as n_rows, cast(rows_7 as bigint) as rows_7, cast(rows_30 as bigint) as rows_30, "
    + ", ".join(f"round({c}_{p} + {NUDGE}, 6) as {c}_{p}" for p in (7, 30) for c in ("total", "avg", "day_avg")) + " from rolled",
}
