"""Joins, aggregates, windows and set operations over the code index and its ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import paths, texts
from lodestrand.operators import fusion, merge, shaping
from lodestrand.plans.registry import Registry

R = Registry()
q = R.add
MONEY = 6

# ---- joins


@q("vector_files__J15", """
select distinct v.vid, f.path as label from vectors v join files f on try_cast(v.ref_id as bigint) = f.id where v.type = 'file'
union all select distinct v.vid, s.name from vectors v join symbols s on try_cast(v.ref_id as bigint) = s.id where v.type like 'symbol%'""")
def vector_files(t):
    """Vectors hydrated to their file or symbol; those that point to nothing drop out."""
    v = t.vectors.select("vid", "type", F.expr("try_cast(ref_id as bigint)").alias("id")).distinct()
    files = v.where("type = 'file'").join(t.files.select("id", F.col("path").alias("label")), "id").select("vid", "label").distinct()
    symbols = v.where("type like 'symbol%'").join(t.symbols.select("id", F.col("name").alias("label")), "id").select("vid", "label").distinct()
    return files.unionByName(symbols)


@q("run_costs_left__J5", "select r.id, coalesce(c.usd, 0) as usd, coalesce(c.calls, 0) as calls from runs r left join (select run_id, round(sum(cost_usd), 6) as usd, count(*) as calls from costs group by 1) c on r.id = c.run_id")
def run_costs_left(t):
    spent = t.costs.where("run_id is not null").groupBy(F.col("run_id").alias("id")).agg(F.round(F.sum("cost_usd"), MONEY).alias("usd"), F.count("*").alias("calls"))
    return t.runs.select("id").join(spent, "id", "left").select("id", F.coalesce("usd", F.lit(0.0)).alias("usd"), F.coalesce("calls", F.lit(0)).alias("calls"))


@q("files_by_concept__J8", "select distinct f.id, f.path from files f, (select id, unnest(concepts) as c from files) x where x.id = f.id and lower(trim(x.c)) = 'configuration'")
def files_by_concept(t):
    hit = t.files.where(F.exists("concepts", lambda c: F.lower(F.trim(c)) == "configuration"))
    return hit.select("id", "path")


@q("projects_with_notes__J9", "select id, name from projects p where exists (select 1 from snapshots s where s.project_id = p.id and s.archived_at is null)")
def projects_with_notes(t):
    return t.projects.join(t.snapshots.where("archived_at is null").select(F.col("project_id").alias("id")), "id", "left_semi").select("id", "name")


@q("orphan_vectors__J10", "select distinct vid from vectors v where type = 'file' and not exists (select 1 from files f where cast(f.id as varchar) = v.ref_id)")
def orphan_vectors(t):
    return merge.orphans(t.vectors.where("type = 'file'").select("vid", "ref_id"), t.files.select(F.col("id").cast("string").alias("ref_id")), ["ref_id"]).select("vid").distinct()


@q("latest_vector__J11", "select vid, max(ref_id) as ref_id from vectors where vid in (select vid from vectors group by 1 having count(*) > 1) group by 1")
def latest_vector(t):
    repeated = t.vectors.groupBy("vid").agg(F.count("*").alias("n"), F.max("ref_id").alias("ref_id")).where("n > 1")
    return repeated.select("vid", "ref_id")


@q("notes_by_tag__J12", "select id, tag from (select id, unnest(tags) as tag from snapshots) where tag in ('log', 'vector', 'secret')")
def notes_by_tag(t):
    return t.snapshots.select("id", F.explode("tags").alias("tag")).where(F.col("tag").isin("log", "vector", "secret"))


@q("stale_links__J13", """
select v.vid, f.path is null or f.embedding_hash is null or f.embedding_hash <> f.content_hash as stale
from (select distinct vid, ref_id from vectors where type = 'file') v left join files f on cast(f.id as varchar) = v.ref_id""")
def stale_links(t):
    links = t.vectors.where("type = 'file'").select("vid", "ref_id").distinct()
    now = t.files.select(F.col("id").cast("string").alias("ref_id"), "path", "embedding_hash", "content_hash")
    return links.join(now, "ref_id", "left").select("vid", (F.col("path").isNull() | ~F.col("embedding_hash").eqNullSafe(F.col("content_hash"))).alias("stale"))


@q("file_blobs__J14", "select f.id, f.path, length(c.content) as n from files f join file_contents c on f.id = c.file_id")
def file_blobs(t):
    return t.files.select("id", "path").join(t.file_contents.select(F.col("file_id").alias("id"), F.length("content").cast("bigint").alias("n")), "id")


@q("project_links__J19", "select p.id, count(distinct r.kind) as kinds, max(case when c.cost_usd > 0 then 1 else 0 end) = 1 as paid from projects p join runs r on r.project_id = p.id join costs c on c.run_id = r.id group by 1")
def project_links(t):
    paid = t.costs.where("run_id is not null").groupBy("run_id").agg(F.max((F.col("cost_usd") > 0).cast("int")).alias("paid"))
    joined = t.runs.select(F.col("id").alias("run_id"), "project_id", "kind").join(paid, "run_id").join(t.projects.select(F.col("id").alias("project_id")), "project_id")
    return joined.groupBy(F.col("project_id").alias("id")).agg(F.countDistinct("kind").alias("kinds"), (F.coalesce(F.max("paid"), F.lit(0)) == 1).alias("paid"))


# ---- aggregates


@q("project_stats__A1", """
select f.project_id, count(*) as files, coalesce(sum(size), 0) as bytes, count(distinct lower(language)) as languages, max(updated_at) as updated, sum(case when semantic_hash is null or semantic_hash <> content_hash then 1 else 0 end) as stale, coalesce(max(r.runs), 0) as runs
from files f left join (select project_id, count(*) as runs from runs group by 1) r on r.project_id = f.project_id group by 1""")
def project_stats(t):
    runs = t.runs.groupBy("project_id").agg(F.count("*").alias("runs"))
    own = t.files.groupBy("project_id").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct(F.lower("language")).alias("languages"), F.max("updated_at").alias("updated"),
        F.sum(F.when(~F.col("semantic_hash").eqNullSafe(F.col("content_hash")), 1).otherwise(0)).alias("stale"))
    return own.join(runs, "project_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


@q("language_counts__A1b", "select project_id, lower(language) as language, count(*) as n from files group by 1, 2")
def language_counts(t):
    return t.files.groupBy("project_id", F.lower("language").alias("language")).agg(F.count("*").alias("n"))


@q("concept_counts__A2", "select lower(trim(c)) as concept, count(*) as n from (select unnest(concepts) as c from files) where trim(c) <> '' group by 1")
def concept_counts(t):
    return t.files.select(F.explode("concepts").alias("c")).where(F.trim("c") != "").groupBy(F.lower(F.trim("c")).alias("concept")).agg(F.count("*").alias("n"))


@q("layer_counts__A2b", "select coalesce(layer, 'unknown') as layer, count(*) as n from files group by 1")
def layer_counts(t):
    return t.files.groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"))


@q("cost_summary__A3", """
select project_id, round(coalesce(sum(cost_usd), 0), 6) as total, round(coalesce(sum(case when operation = 'analyze' then cost_usd else 0 end), 0), 6) as analysis, round(coalesce(sum(case when operation = 'embed' then cost_usd else 0 end), 0), 6) as embedding,
 coalesce(sum(case when operation = 'analyze' then input_tokens else 0 end), 0) as input_tokens, coalesce(sum(case when operation = 'embed' then input_tokens else 0 end), 0) as embedding_tokens, count(distinct run_id) as runs
from costs where created_at >= timestamp '2025-02-01' group by 1""")
def cost_summary(t):
    when = lambda op, c: F.coalesce(F.sum(F.when(F.col("operation") == op, F.col(c)).otherwise(0)), F.lit(0))
    since = t.costs.where("created_at >= timestamp '2025-02-01'")
    return since.groupBy("project_id").agg(
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)), MONEY).alias("total"), F.round(when("analyze", "cost_usd"), MONEY).alias("analysis"), F.round(when("embed", "cost_usd"), MONEY).alias("embedding"),
        when("analyze", "input_tokens").alias("input_tokens"), when("embed", "input_tokens").alias("embedding_tokens"), F.countDistinct("run_id").alias("runs"))


@q("global_costs__A4", """
select provider, p.name as project, round(sum(cost_usd), 6) as usd, count(*) as calls from costs c join projects p on p.id = c.project_id group by grouping sets ((), (provider), (p.name))""")
def global_costs(t):
    """Totals, by provider and by project in one pass over pre-aggregated rows."""
    pre = t.costs.groupBy("project_id", "provider").agg(F.sum("cost_usd").alias("usd"), F.count("*").alias("calls"))
    named = pre.join(t.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    sets = named.groupingSets([[], ["provider"], ["project"]], "provider", "project").agg(F.round(F.sum("usd"), MONEY).alias("usd"), F.sum("calls").alias("calls"))
    return sets.select("provider", "project", "usd", "calls")


@q("run_costs__A5", "select run_id, round(coalesce(sum(cost_usd), 0), 6) as usd, coalesce(sum(input_tokens), 0) as input_tokens, coalesce(sum(output_tokens), 0) as output_tokens from costs where run_id is not null group by 1")
def run_costs(t):
    return t.costs.where("run_id is not null").groupBy("run_id").agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)), MONEY).alias("usd"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


@q("coverage__A6", "select project_id, count(*) as files, count(embedding_hash) as embedded, sum(case when embedding_hash = content_hash then 1 else 0 end) as fresh, round(count(embedding_hash) / count(*), 6) as share from files group by 1")
def coverage(t):
    return t.files.groupBy("project_id").agg(
        F.count("*").alias("files"), F.count("embedding_hash").alias("embedded"), F.sum(F.when(F.col("embedding_hash") == F.col("content_hash"), 1).otherwise(0)).alias("fresh"), F.round(F.count("embedding_hash") / F.count("*"), 6).alias("share"))


@q("tier_breakdown__A8", "select project_id, coalesce(index_tier, 'untagged') as tier, count(*) as n from files group by 1, 2")
def tier_breakdown(t):
    return t.files.groupBy("project_id", F.coalesce("index_tier", F.lit("untagged")).alias("tier")).agg(F.count("*").alias("n"))


@q("hygiene__A9", """
select p.id, (select count(*) from files f where f.project_id = p.id) as files, coalesce((select sum(n - 1) from (select vid, count(*) as n from vectors v where v.project_name = p.name group by 1 having count(*) > 1)), 0) as repeated,
 (select count(*) from runs r where r.project_id = p.id and r.finished_at is null) as unfinished, (select max(started_at) from runs r where r.project_id = p.id) as last_run from projects p""")
def hygiene(t):
    """Each measure is aggregated once and joined, never a subquery per project."""
    files = t.files.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("files"))
    repeated = t.vectors.where("project_name is not null").groupBy("project_name", "vid").agg(F.count("*").alias("n")).where("n > 1").groupBy(F.col("project_name").alias("name")).agg(F.sum(F.col("n") - 1).alias("repeated"))
    runs = t.runs.groupBy(F.col("project_id").alias("id")).agg(F.count(F.when(F.col("finished_at").isNull(), 1)).alias("unfinished"), F.max("started_at").alias("last_run"))
    out = t.projects.select("id", "name").join(files, "id", "left").join(repeated, "name", "left").join(runs, "id", "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "repeated", "unfinished")), "last_run")


@q("vector_types__A10", "select coalesce(type, 'all') as type, count(*) as n from vectors group by rollup (type)")
def vector_types(t):
    return t.vectors.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("all")).alias("type"), "n")


@q("notes_by_category__A11", "select project_id, category, count(*) as n, count(archived_at) as archived from snapshots group by 1, 2")
def notes_by_category(t):
    return t.snapshots.groupBy("project_id", "category").agg(F.count("*").alias("n"), F.count("archived_at").alias("archived"))


@q("pulse__A12", """
with c as (select project_id, lower(trim(u)) as concept, count(*) as n from (select project_id, unnest(concepts) as u from files) where trim(u) <> '' group by 1, 2)
select project_id, concept, n from (select *, row_number() over (partition by project_id order by n desc, concept) as rn from c) where rn <= 8""")
def pulse(t):
    """The eight commonest concepts of each project."""
    counts = t.files.select("project_id", F.explode("concepts").alias("u")).where(F.trim("u") != "").groupBy("project_id", F.lower(F.trim("u")).alias("concept")).agg(F.count("*").alias("n"))
    return fusion.top_k(counts, "n", "concept", 8, ["project_id"])


@q("extensions__A15", r"""select ext, n from (select coalesce(nullif(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1), ''), '(no extension)') as ext, count(*) as n from files group by 1) order by n desc, ext limit 10""")
def extensions(t):
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return t.files.groupBy(F.when(ext == "", "(no extension)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(10)


@q("vectors_deduped__A16", "select project_name, vid, max(ref_id) as ref_id, count(*) - 1 as dropped from vectors group by 1, 2")
def vectors_deduped(t):
    return t.vectors.groupBy("project_name", "vid").agg(F.max("ref_id").alias("ref_id"), (F.count("*") - 1).alias("dropped"))


@q("blob_refcounts__A17", "select content_hash, count(*) as refcount from files group by 1")
def blob_refcounts(t):
    return merge.refcounts(t.files, "content_hash")


@q("next_versions__A18", "select project_id, title, count(*) + 1 as next_version from snapshots group by 1, 2")
def next_versions(t):
    return t.snapshots.groupBy("project_id", "title").agg((F.count("*") + 1).alias("next_version"))


@q("run_phases__A19", "select kind, status, count(*) as runs, round(avg(date_diff('second', started_at, finished_at)), 3) as seconds, max(date_diff('second', started_at, finished_at)) as longest from runs where finished_at is not null group by 1, 2")
def run_phases(t):
    seconds = F.expr("unix_seconds(cast(finished_at as timestamp)) - unix_seconds(cast(started_at as timestamp))")
    return t.runs.where("finished_at is not null").groupBy("kind", "status").agg(F.count("*").alias("runs"), F.round(F.avg(seconds), 3).alias("seconds"), F.max(seconds).alias("longest"))


BUCKETS = (("<1K", 1_000), ("<4K", 4_000), ("<16K", 16_000), ("<64K", 64_000))


@q("size_histogram__A20", "select case " + " ".join(f"when size < {n} then '{b}'" for b, n in BUCKETS) + " else '>=64K' end as bucket, count(*) as n from files group by 1")
def size_histogram(t):
    case = F.when(F.col("size") < BUCKETS[0][1], BUCKETS[0][0])
    for name, n in BUCKETS[1:]:
        case = case.when(F.col("size") < n, name)
    return t.files.groupBy(case.otherwise(">=64K").alias("bucket")).agg(F.count("*").alias("n"))


# ---- windows and selection


@q("size_ranks__W1", "select id, project_id, cast(row_number() over (partition by project_id order by size desc, id) as int) as rank from files")
def size_ranks(t):
    """Ranks within projects, one of which holds a tenth of the rows or more: by ranges."""
    found = fusion.ranked(t.files.select("id", "project_id", "size"), ["project_id"], [F.desc("size"), F.asc("id")])
    return found.select("id", "project_id", F.col("rank").cast("int").alias("rank"))


@q("first_per_hash__W2", "select id from (select id, row_number() over (partition by content_hash order by id) as rn from files) where rn = 1")
def first_per_hash(t):
    return fusion.first_per_key(t.files.select("id", "content_hash"), ["content_hash"], ["id"]).select("id")


@q("capped_per_file__W3", "select id, file_id from (select id, file_id, row_number() over (partition by file_id order by line, id) as rn from (select distinct id, file_id, line from symbols)) where rn <= 3")
def capped_per_file(t):
    return fusion.capped_per_group(t.symbols.select("id", "file_id", "line").distinct(), ["file_id"], ["line", "id"], 3).select("id", "file_id")


@q("status_islands__W5", """
with m as (select id, project_id, status, started_at, case when status is not distinct from lag(status) over w and lag(1) over w is not null then 0 else 1 end as fresh from runs window w as (partition by project_id order by id)),
n as (select *, sum(fresh) over (partition by project_id order by id) as island from m)
select project_id, any_value(status) as status, min(id) as first, max(id) as last, count(*) as run from n group by project_id, island""")
def status_islands(t):
    return fusion.islands(t.runs.select("id", "project_id", "status"), "status", ["project_id"], ["id"])


@q("neighbour_symbols__W6", "select id, count(*) over (partition by file_id order by line, id rows between 3 preceding and 3 following) as near from (select distinct id, file_id, line from symbols)")
def neighbour_symbols(t):
    w = Window.partitionBy("file_id").orderBy("line", "id").rowsBetween(-3, 3)
    return t.symbols.select("id", "file_id", "line").distinct().select("id", F.count("*").over(w).alias("near"))


@q("path_budget__W7", "select id, used from (select id, sum(length(path) + 1) over (partition by project_id order by path, id rows unbounded preceding) as used from files) where used <= 500")
def path_budget(t):
    return fusion.within_budget(t.files.select("id", "project_id", "path", F.length("path").alias("n")), "n", ["project_id"], ["path", "id"], 500).select("id", "used")


@q("last_runs__W8", "select id, project_id from (select id, project_id, row_number() over (partition by project_id order by finished_at desc, id desc) as rn from runs where finished_at is not null and kind = 'full') where rn <= 2")
def last_runs(t):
    w = Window.partitionBy("project_id").orderBy(F.desc("finished_at"), F.desc("id"))
    return t.runs.where("finished_at is not null and kind = 'full'").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("id", "project_id")


@q("latest_notes__W9", "select project_id, category, max_by(id, row(created_at, id)) as id from snapshots group by 1, 2")
def latest_notes(t):
    return merge.latest(t.snapshots.select("project_id", "category", "created_at", "id"), ["project_id", "category"], "created_at", "id").select("project_id", "category", "id")


@q("changed_revisions__W10", "select id from (select id, content, row_number() over w as rn, lag(content) over w as prev from snapshots window w as (partition by project_id, title order by created_at, id)) where rn = 1 or content is distinct from prev")
def changed_revisions(t):
    return merge.changed_revisions(t.snapshots.select("id", "project_id", "title", "created_at", "content"), ["project_id", "title"], ["created_at", "id"], "content").select("id")


@q("top_notes__K1", "select id, importance from snapshots where importance is not null order by importance desc, id limit 25")
def top_notes(t):
    return fusion.top_k(t.snapshots.where("importance is not null").select("id", "importance"), "importance", "id", 25)


@q("diverse_notes__K2", """
with a as (select id, project_id, category, importance * power(0.5, row_number() over (partition by project_id, category order by importance desc, id) - 1) as effective from snapshots where importance is not null)
select project_id, id, round(effective, 9) as effective, cast(slot as int) as slot from (select *, row_number() over (partition by project_id order by effective desc, id) as slot from a) where slot <= 5""")
def diverse_notes(t):
    rows = t.snapshots.where("importance is not null").select("id", "project_id", "category", "importance")
    return fusion.diverse(rows, "project_id", "category", "importance", "id", 5).select("project_id", "id", F.round("effective", 9).alias("effective"), "slot")


@q("blended_notes__K3")
def blended_notes(t):
    """Notes of a project blended over their categories, each category spaced by two slots."""
    w = Window.partitionBy("project_id", "category").orderBy(F.desc_nulls_last("importance"), "id")
    rows = t.snapshots.select("project_id", "category", F.col("id").alias("candidate"), F.row_number().over(w).alias("pos"), F.col("importance")).where("pos <= 10")
    tracks = rows.select("project_id", F.col("category").alias("track"), F.dense_rank().over(Window.partitionBy("project_id").orderBy("category")).alias("track_ord"), "pos", "candidate")
    return fusion.blended(tracks, "project_id", 8, spacing=2)


@q("coverage_notes__X27", """
with c as (select project_id, count(*) as files, count(embedding_hash) as embedded, count(case when semantic_hash <> content_hash then 1 end) as stale from files group by 1)
select project_id, files, embedded, stale, nullif(concat_ws('; ', case when embedded = 0 then 'words only, no embeddings yet' when embedded < files then 'embeddings cover ' || embedded || ' of ' || files || ' files' end, case when stale > 0 then stale || ' files changed since their last summary' end), '') as note from c""")
def coverage_notes(t):
    """What a search in each project can't see."""
    return shaping.covered(t.files).withColumn("note", shaping.coverage_note(F.col("files"), F.col("embedded"), F.col("stale")))


@q("multi_key_order__K5", "select id from (select distinct id, exported, name from symbols) order by exported desc nulls last, length(name), name, id limit 30")
def multi_key_order(t):
    return t.symbols.select("id", "exported", "name").distinct().orderBy(F.desc("exported"), F.length("name"), "name", "id").limit(30).select("id")


@q("proximity__K6", r"""
with o as (select project_id, path, regexp_replace(path, '/[^/]*$', '') as dir from files where id = 5)
select f.id from files f, o where f.project_id = o.project_id order by case when f.path = o.path then 0 when regexp_replace(f.path, '/[^/]*$', '') = o.dir then 1 else 2 end, f.id limit 20""")
def proximity(t):
    """Files of a project by nearness to one: itself, its directory, the rest."""
    origin = t.files.where("id = 5").select("project_id", F.col("path").alias("o_path"))
    near = F.when(F.col("path") == F.col("o_path"), 0).when(paths.dirname(F.col("path")) == paths.dirname(F.col("o_path")), 1).otherwise(2)
    return t.files.join(F.broadcast(origin), "project_id").orderBy(near, "id").limit(20).select("id")


@q("global_merge__K7", "select id, project_id, importance from (select id, project_id, importance, row_number() over (partition by project_id order by importance desc, id) as rn from snapshots where importance is not null) where rn <= 5 order by importance desc, id limit 50")
def global_merge(t):
    capped = fusion.top_k(t.snapshots.where("importance is not null").select("id", "project_id", "importance"), "importance", "id", 5, ["project_id"])
    return capped.orderBy(F.desc("importance"), "id").limit(50)


@q("memory_index__K8", """
with top as (select id, importance, created_at from snapshots where archived_at is null and importance is not null order by importance desc, id limit 100)
select id, round(importance * power(0.5, date_diff('second', created_at, timestamp '2026-01-01') / 86400.0 / 30), 9) as score from top order by 2 desc, id limit 20""")
def memory_index(t):
    """A hundred most important notes, then the twenty that recency leaves on top."""
    top = t.snapshots.where("archived_at is null and importance is not null").orderBy(F.desc("importance"), "id").limit(100)
    age = F.expr("(unix_seconds(timestamp '2026-01-01 00:00:00') - unix_seconds(cast(created_at as timestamp))) / 86400.0D / 30")
    return top.select("id", F.round(F.col("importance") * F.pow(F.lit(0.5), age), 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@q("recently_modified__K10", "select id, path from files order by updated_at desc, id limit 50")
def recently_modified(t):
    return t.files.orderBy(F.desc("updated_at"), "id").limit(50).select("id", "path")


# ---- sets


@q("bag_union__UALL", "select name as label from symbols union all select path from files")
def bag_union(t):
    return t.symbols.select(F.col("name").alias("label")).union(t.files.select("path"))


@q("distinct_union__UDIST", "select name as label from symbols union select path from files")
def distinct_union(t):
    return t.symbols.select(F.col("name").alias("label")).union(t.files.select("path")).distinct()


@q("insert_or_ignore__UINS", "select distinct project_id, lower(trim(c)) as concept from (select project_id, unnest(concepts) as c from files union all select project_id, unnest(tags) from snapshots) where trim(c) <> ''")
def insert_or_ignore(t):
    both = t.files.select("project_id", F.explode("concepts").alias("c")).union(t.snapshots.select("project_id", F.explode("tags")))
    return both.where(F.trim("c") != "").select("project_id", F.lower(F.trim("c")).alias("concept")).dropDuplicates()


@q("removed_set__UDIFF", "select distinct ref_id from vectors where type = 'file' except select cast(id as varchar) from files")
def removed_set(t):
    return t.vectors.where("type = 'file'").select("ref_id").subtract(t.files.select(F.col("id").cast("string")))


@q("run_diff__URDIFF", """
with m as (select project_id, strftime(created_at, '%Y-%m') as month, category from snapshots),
a as (select project_id, category from m where month <= '2025-06' group by 1, 2), b as (select project_id, category from m where month > '2025-06' group by 1, 2)
select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.category, b.category) as category, case when a.category is null then 'added' when b.category is null then 'removed' else 'unchanged' end as kind
from a full join b on a.project_id = b.project_id and a.category = b.category""")
def run_diff(t):
    """Categories of notes a project gained or lost from the first half of 2025 to the second."""
    rows = t.snapshots.select("project_id", "category", F.date_format("created_at", "yyyy-MM").alias("month"), F.lit(1).alias("one"))
    old, new = (rows.where(c).select("project_id", "category", "one").distinct() for c in ("month <= '2025-06'", "month > '2025-06'"))
    return merge.classified(old, new, ["project_id", "category"], "one")
