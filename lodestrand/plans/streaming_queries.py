"""Batch twins of the streaming operators over the events table; the streams themselves are tested against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.plans.registry import Registry
from lodestrand.streaming import changes

R = Registry()
q = R.add


def _changes(t):
    """Events as file changes: an error removes, anything else upserts, the page k is the path."""
    k = F.get_json_object("props", "$.k")
    return t.events.select(F.col("user_id").alias("project_id"), F.concat(F.lit("p/"), k).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("kind"), F.lit(False).alias("is_dir"), F.col("event_id").alias("seq"), "ts")


_CHANGES = "select user_id as project_id, 'p/' || json_extract_string(props, '$.k') as path, case when event_type = 'error' then 'delete' else 'upsert' end as kind, event_id as seq from events"


@q("sessions__T2", """
with m as (select user_id, ts, case when ts <= lag(ts) over w + interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from m)
select user_id, count(*) as n, cast(floor(epoch(min(ts))) as bigint) as started from n group by user_id, s""")
def sessions(t):
    """Debounced batches: a user's events until six quiet hours."""
    found = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", "n", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("started"))


@q("dirty_queue__T3", f"select project_id, path, max_by(kind, seq) as kind, case when max_by(kind, seq) = 'delete' then 0 else 1 end as step from ({_CHANGES}) group by 1, 2")
def dirty_queue(t):
    return changes.coalesced(_changes(t)).select("project_id", "path", "kind", "step")


@q("touch_state__T4", "select user_id, cast(floor(epoch(max(ts))) as bigint) as last, count(*) as n, bool_or(event_type = 'purchase') as edited from events group by 1")
def touch_state(t):
    state = changes.touches(t.events.withColumn("hit", F.col("event_type") == "purchase"), "user_id", "ts", "hit")
    return state.select("user_id", F.unix_seconds(F.col("last").cast("timestamp")).alias("last"), "n", "edited")


@q("recent_touches__S20", """
with s as (select user_id, json_extract_string(props, '$.k') as page, max(ts) as last, bool_or(event_type = 'purchase') as edited from events group by 1, 2),
h as (select *, cast(row_number() over (partition by user_id order by last desc, page) as int) as place from s)
select user_id, page, place, round(0.4 * power(2, -greatest(0, floor(epoch(timestamp '2026-01-01')) - floor(epoch(last))) / 2592000.0) + case when edited then 0.1 else 0 end, 9) as score from h where place <= 5""")
def recent_touches(t):
    """The five pages that each user touched last, by recency and edits."""
    hits = t.events.select("user_id", F.get_json_object("props", "$.k").alias("page"), "ts", (F.col("event_type") == "purchase").alias("hit"))
    state = hits.groupBy("user_id", "page").agg(F.max("ts").alias("last"), F.bool_or("hit").alias("edited"))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    found = changes.recent(state, ["page"], ["user_id"], now, 2_592_000.0, 5)
    return found.select("user_id", "page", "place", F.round("score", 9).alias("score"))


@q("sliding_counts__T5", """
select event_type, cast(floor(epoch(s)) as bigint) as started, count(*) as n from (select event_type, unnest([time_bucket(interval 6 hours, ts, timestamp '1970-01-01'), time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - interval 6 hours]) as s from events) group by 1, 2""")
def sliding_counts(t):
    """Twelve-hour windows every six hours."""
    w = F.window("ts", "12 hours", "6 hours")
    return t.events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("started"), "n")


@q("tumbling_counts__T1", "select event_type, cast(floor(epoch(time_bucket(interval 1 day, ts, timestamp '1970-01-01'))) as bigint) as started, count(*) as n from events group by 1, 2")
def tumbling_counts(t):
    return t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("started"), "n")


@q("expired__T6", "select user_id, max(ts) < (select max(ts) from events) - interval 2 days as expired from events group by 1")
def expired(t):
    """Keys whose time to live has passed at the newest event."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = t.events.agg(F.max("ts")).first()[0]
    return last.select("user_id", (F.col("last") < F.lit(end).cast("timestamp_ntz") - F.expr("interval 2 days")).alias("expired"))


@q("reindexed__T7", f"with c as (select project_id, path, max_by(kind, seq) as kind, max(seq) as seq from ({_CHANGES}) group by 1, 2) select project_id, path, seq from c where kind = 'upsert'")
def reindexed(t):
    """The indexed paths after all changes, from an empty index."""
    batch = changes.coalesced(_changes(t))
    return changes.applied(t.spark.createDataFrame([], "project_id bigint, path string, seq bigint"), batch)


@q("scan_guards__T10", "select * from (values (10, 5, 100, 'ok'), (0, 5, 100, 'empty_scan'), (0, 0, 100, 'ok'), (101, 5, 100, 'too_large')) v(found, known, most, verdict)")
def scan_guards(t):
    cases = [(10, 5, 100), (0, 5, 100), (0, 0, 100), (101, 5, 100)]
    return t.spark.createDataFrame([(*c, changes.guarded(*c)) for c in cases], "found int, known int, most int, verdict string")
