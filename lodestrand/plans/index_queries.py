"""Scans, filters, scalars and writes over the code index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import paths, texts
from lodestrand.operators import merge
from lodestrand.plans.registry import Registry
from lodestrand.session import cut

R = Registry()
q = R.add
NOW = "timestamp '2026-01-01 00:00:00'"

_P = r"lower(replace(path, '\', '/'))"
_BASE = rf"regexp_extract({_P}, '([^/]*)$', 1)"
_DIRS = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in paths.EXCLUDED_DIRS) + ")"
_SUFFIX = "(" + "|".join(s.replace(".", r"\.") for s in paths.EXCLUDED_SUFFIXES) + ")$"
_LOCKS = ", ".join(f"'{x}'" for x in paths.LOCKFILES)
_GONE = f"({_BASE} in ({_LOCKS}) or regexp_matches({_P}, '{_SUFFIX}') or regexp_matches({_P}, '{_DIRS}') or regexp_matches({_P}, '{paths.MADE_DIRS}'))"
_TIER = f"case when {_GONE} or size > {paths.OVERSIZED} then 'excluded' when regexp_matches({_P}, '{paths.ON_DEMAND}') then 'on_demand' when regexp_matches({_P}, '{paths.CORE}') then 'core' else 'support' end"
_EXT = rf"regexp_extract({_BASE}, '\.([^.]*)$', 1)"
_LANG = f"case when {_BASE} = 'dockerfile' then 'dockerfile' " + " ".join("when {} in ({}) then '{}'".format(_EXT, ", ".join(f"'{x}'" for x in names), lang) for lang, names in paths.LANGUAGES.items()) + " else 'plaintext' end"
_ROLE = "case " + " ".join(f"when regexp_matches({_BASE}, '{p}') then '{r}'" for p, r in paths.ROLES) + r" when regexp_matches(path, '(^|/)[A-Z][^/]*\.[jt]sx$') then 'React component' end"
_LAYER = "case when layer in ('" + "', '".join(n for n, *_ in paths.LAYERS) + "') then layer " + " ".join(
    f"when regexp_matches({_BASE}, '{b}') or regexp_matches({_P}, '{p}')" + (" or role in ('" + "', '".join(roles) + "')" if roles else "") + f" then '{n}'" for n, b, p, roles in paths.LAYERS
) + f" when regexp_matches({_BASE}, '{paths.SOURCE}') then 'business' else 'unknown' end"


@q("incremental_diff__S1", """
select coalesce(a.file_id, b.file_id) as file_id, case when a.file_id is null then 'added' when b.file_id is null then 'removed' when a.h = b.h then 'unchanged' else 'modified' end as kind
from (select id as file_id, semantic_hash as h from files where semantic_hash is not null
      union select distinct cast(ref_id as bigint), null from vectors where type = 'file' and try_cast(ref_id as bigint) is not null and cast(ref_id as bigint) not in (select id from files)) a
full join (select id as file_id, content_hash as h from files) b on a.file_id = b.file_id""")
def incremental_diff(t):
    """What a scan adds, modifies, removes or finds unchanged against the state last indexed (semantic_hash, and vectors of files that are gone)."""
    files = t.files
    gone = t.vectors.where("type = 'file'").select(F.expr("try_cast(ref_id as bigint)").alias("file_id")).where("file_id is not null").distinct().join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    old = files.where("semantic_hash is not null").select(F.col("id").alias("file_id"), F.col("semantic_hash").alias("h")).union(gone.select("file_id", F.lit(None).cast("string")))
    return merge.classified(old, files.select(F.col("id").alias("file_id"), F.col("content_hash").alias("h")), ["file_id"], "h")


IGNORES = ["# build output", "dist/", "*.min.js", "**/generated/**", "vendor/", "!vendor/keep.py", "/docs/*.md"]


@q("ignored_paths__S2", rf"""
select id, path from files where {_GONE} or regexp_matches({_P}, '{paths.BINARY}') or
 (regexp_matches(path, '(^|/)dist/') or regexp_matches(path, '(^|/)[^/]*\.min\.js(/|$)') or regexp_matches(path, '^(.*/)?generated/.*(/|$)') or regexp_matches(path, '(^|/)vendor/') and not regexp_matches(path, '^vendor/keep\.py(/|$)') or regexp_matches(path, '^docs/[^/]*\.md(/|$)'))""")
def ignored_paths(t):
    p = F.col("path")
    return t.files.where(paths.hard_excluded(p) | paths.binary_name(p) | paths.ignored(p, IGNORES)).select("id", "path")


@q("index_tier__S3", f"select id, path, {_TIER} as tier from files")
def index_tier(t):
    return t.files.select("id", "path", paths.index_tier(F.col("path"), F.col("size")).alias("tier"))


@q("hard_excluded__S5", f"select id, {_GONE} as excluded from files")
def hard_excluded(t):
    return t.files.select("id", paths.hard_excluded(F.col("path")).alias("excluded"))


_IMPORT = r"""(?m)^\s*(?:import\b[^\n;]*?from\s+['"]([^'"\n]+)['"]|from\s+([\w.]+)\s+import|import\s+(?:static\s+)?([\w.]+);?\s*$|import\s+"([^"\n]+)")"""


@q("imports__S8", rf"""
with each as (select file_id, unnest(regexp_extract_all(content, '{_IMPORT.replace("'", "''")}')) as hit from file_contents where supported)
select file_id, trim(regexp_replace(hit, '\s+', ' ', 'g')) as statement, count(*) as n from each group by all""")
def imports(t):
    hits = t.file_contents.where("supported").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(0))).alias("hit"))
    return hits.groupBy("file_id", F.trim(F.regexp_replace("hit", r"\s+", " ")).alias("statement")).agg(F.count("*").alias("n"))


@q("indexable__S10", r"""select file_id, strlen(content) > 0 and strlen(content) <= 204800 and position(chr(0) in content) = 0 and length(content) / (length(content) - length(replace(content, chr(10), '')) + 1.0) <= 500 as indexable from file_contents""")
def indexable(t):
    return t.file_contents.select("file_id", texts.indexable(F.col("content")).alias("indexable"))


@q("directory__S13", r"select id, path, size from files where starts_with(path, 'src/') and length(path) - length(replace(path, '/', '')) <= 2 order by path limit 200")
def directory(t):
    """The first 200 entries below a prefix, up to two levels deep."""
    deep = F.size(F.split("path", "/")) - 1
    return t.files.where(F.col("path").startswith("src/") & (deep <= 2)).select("id", "path", "size").orderBy("path", "id").limit(200)


@q("namespaces__S17", "select namespace, regexp_replace(namespace, '[^A-Za-z0-9_-]', '_', 'g') as token, count(*) as n from vectors where namespace like 'code:%' group by 1, 2")
def namespaces(t):
    """Vectors per tenant; written with partitionBy(namespace) the filter prunes partitions."""
    return t.vectors.where(F.col("namespace").startswith("code:")).groupBy("namespace", texts.namespace_token(F.col("namespace")).alias("token")).agg(F.count("*").alias("n"))


@q("embed_targets__S19", "select id, path from files where embedding_hash is null or embedding_hash <> content_hash")
def embed_targets(t):
    return t.files.where(~F.col("embedding_hash").eqNullSafe(F.col("content_hash"))).select("id", "path")


@q("fan_out__S21", "select 'file' as kind, id, project_id from files union all select 'symbol', id, project_id from symbols union all select 'snapshot', id, project_id from snapshots")
def fan_out(t):
    parts = [(k, getattr(t, n)) for k, n in (("file", "files"), ("symbol", "symbols"), ("snapshot", "snapshots"))]
    frames = [df.select(F.lit(k).alias("kind"), "id", "project_id") for k, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@q("split_parity__S22", """
select project_id, sum(f) as files, sum(c) as contents, sum(f) = sum(c) as equal from (select project_id, 1 as f, 0 as c from files union all select project_id, 0, 1 from file_contents) group by 1""")
def split_parity(t):
    """Rows of each shard on both sides of a split."""
    both = t.files.select("project_id", F.lit(1).alias("f"), F.lit(0).alias("c")).union(t.file_contents.select("project_id", F.lit(0), F.lit(1)))
    return both.groupBy("project_id").agg(F.sum("f").alias("files"), F.sum("c").alias("contents")).withColumn("equal", F.col("files") == F.col("contents"))


@q("point_lookup__P1", "select id, path, language, size from files where id = 42")
def point_lookup(t):
    return t.files.where("id = 42").select("id", "path", "language", "size")


@q("list_filtered__P2", "select id, path from files where language = 'python' order by path, id limit 100")
def list_filtered(t):
    return t.files.where("language = 'python'").select("id", "path").orderBy("path", "id").limit(100)


@q("dynamic_predicate__P3", "select distinct id, name, kind from symbols where kind = 'method' and exported and name like 'render%'")
def dynamic_predicate(t, name="render", kind="method", exported=True):
    keep = F.lit(True)
    for condition, wanted in ((F.col("name").startswith(name or ""), name), (F.col("kind") == kind, kind), (F.col("exported") == exported, exported)):
        keep = keep & condition if wanted is not None else keep
    return t.symbols.where(keep).select("id", "name", "kind").distinct()


@q("prefix_search__P4", "select id, name from (select distinct id, name, exported from symbols where starts_with(name, 'com')) order by exported desc nulls last, length(name), name, id limit 50")
def prefix_search(t):
    found = t.symbols.where(F.col("name").startswith("com")).select("id", "name", "exported").distinct()
    return found.orderBy(F.desc("exported"), F.length("name"), "name", "id").limit(50).select("id", "name")


@q("language_in__P5", "select id, lower(language) in ('python', 'go') as inside from files where lower(language) in ('python', 'go', 'java') and lower(language) not in ('java')")
def language_in(t):
    low = F.lower("language")
    return t.files.where(low.isin("python", "go", "java") & ~low.isin("java")).select("id", low.isin("python", "go").alias("inside"))


@q("language_of_hit__P6", f"select id, coalesce(lower(language), {_LANG}) as hit_language from files where coalesce(lower(language), {_LANG}) = 'typescript'")
def language_of_hit(t):
    own = F.coalesce(F.lower("language"), paths.language_id(F.col("path")))
    return t.files.where(own == "typescript").select("id", own.alias("hit_language"))


@q("semantic_stale__P7", "select id, path from files where semantic_hash is null or semantic_hash <> content_hash")
def semantic_stale(t):
    return t.files.where("semantic_hash is null or semantic_hash <> content_hash").select("id", "path")


@q("languages_lowered__P8", "select id, lower(language) as language from files where language is not null and language <> lower(language)")
def languages_lowered(t):
    return t.files.where("language is not null and language <> lower(language)").select("id", F.lower("language").alias("language"))


@q("like_fallback__P9", "select id, title from snapshots where contains(title, 'rules') or contains(content, 'rules')")
def like_fallback(t):
    return t.snapshots.where(F.contains("title", F.lit("rules")) | F.contains("content", F.lit("rules"))).select("id", "title")


@q("glob__P10", r"select id, path from files where regexp_matches(path, '^src/(.*/)?[^/]*\.(ts|mts)$')")
def glob(t):
    return t.files.where(F.col("path").rlike(paths.glob_pattern("src/**/*.{ts,mts}"))).select("id", "path")


@q("json_hydrated__P11", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type = 'error' as failed from events")
def json_hydrated(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select("event_id", parsed["k"].alias("k"), (F.col("event_type") == "error").alias("failed"))


@q("slim_columns__P12", "select id, content_hash, mtime_ms, size from files")
def slim_columns(t):
    return t.files.select("id", "content_hash", "mtime_ms", "size")


@q("sample_embedded__P13")
def sample_embedded(t):
    """Ten embedded files drawn with a seed."""
    return t.files.where("embedding_hash is not null").orderBy(F.rand(7)).limit(10).select("id", "path")


@q("symbols_matching__P14", "select distinct id, name from symbols where kind in ('class', 'interface') and regexp_matches(name, '^(Idle|Broken).*(Queue|Router)$')")
def symbols_matching(t):
    return t.symbols.where(F.col("kind").isin("class", "interface") & F.col("name").rlike("^(Idle|Broken).*(Queue|Router)$")).select("id", "name").distinct()


@q("joined_concepts__P15", """
with c as (select id, list_filter(list_transform(concepts, lambda x: trim(x)), lambda x: x is not null and x <> '') as l from files where concepts is not null),
d as (select id, list_filter(list_transform(range(1, len(l) + 1), lambda i: case when list_position(l, l[i]) = i then l[i] end), lambda x: x is not null) as u from c)
select id, array_to_string(u[1:4], ', ') || case when len(u) > 4 then ', …' else '' end as concepts from d""")
def joined_concepts(t):
    return t.files.where("concepts is not null").select("id", texts.joined_capped(F.col("concepts"), 4).alias("concepts"))


@q("pruned_notes__P16", "select id from (select id, row_number() over (partition by project_id order by created_at desc, id desc) as rn from snapshots) where rn > 10")
def pruned_notes(t):
    return merge.beyond(t.snapshots.select("id", "project_id", "created_at"), ["project_id"], ["created_at", "id"], 10).select("id")


@q("hashes__X1", "select file_id, sha256(content) as hash, length(content) - length(replace(content, chr(10), '')) + 1 as lines from file_contents")
def hashes(t):
    return t.file_contents.select("file_id", texts.content_hash(F.col("content")).alias("hash"), texts.line_count(F.col("content")).cast("bigint").alias("lines"))


@q("stable_ids__X2", "select distinct id, sha1(concat(project_id, ':', coalesce(file_path, ''), ':', coalesce(kind, ''), ':', coalesce(parent, ''), ':', coalesce(name, ''), ':', coalesce(signature, ''))) as made from symbols")
def stable_ids(t):
    return t.symbols.select("id", texts.stable_id(*(F.col(c) for c in ("project_id", "file_path", "kind", "parent", "name", "signature"))).alias("made")).distinct()


@q("fnv_ids__X3", """select vid, cast(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split(vid, ''), lambda x: ascii(x)::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) % 9007199254740992::uhugeint as bigint) as point from (select distinct vid from vectors)""")
def fnv_ids(t):
    """Point ids of vectors: FNV-1a, Arrow batches."""
    @F.pandas_udf("bigint")
    def fnv(names: pd.Series) -> pd.Series:
        return pd.Series(texts.fnv_53_all([(n or "").encode() for n in names]), index=names.index)

    return t.vectors.select("vid").distinct().select("vid", fnv("vid").alias("point"))


@q("language_ids__X4", f"select id, {_LANG} as language_id from files")
def language_ids(t):
    return t.files.select("id", paths.language_id(F.col("path")).alias("language_id"))


@q("file_roles__X5", f"select id, {_ROLE} as role from files")
def file_roles(t):
    return t.files.select("id", paths.file_role(F.col("path")).alias("role"))


@q("layers__X6", f"select id, {_LAYER} as layer, regexp_matches({_BASE}, '{paths.ENTRY_NAMES}') or regexp_matches({_P}, '{paths.ENTRY_PATHS}') as entry from (select *, coalesce({_ROLE}, '') as role from files)")
def layers(t):
    return t.files.select("id", paths.layer(F.col("path"), F.col("layer")).alias("layer"), paths.entry_name(F.col("path")).alias("entry"))


# Name patterns and the tag they give.
TAGS = (("test", "^(test|should)|(Test|Spec)$"), ("handler", "(?i)handle|handler$"), ("factory", "(?i)^(create|make|build)"), ("validator", "(?i)^(validate|check|is|has)"), ("accessor", "^(get|set)[A-Z_]"), ("hook", "^use[A-Z]"), ("async", "(?i)async"), ("private", "^_"))


@q("inferred_tags__X7", "select distinct id, " + " || ".join(f"case when regexp_matches(name, '{p}') then '{n},' else '' end" for n, p in TAGS) + " as tags from symbols where name is not null")
def inferred_tags(t):
    parts = [F.when(F.col("name").rlike(p), f"{n},").otherwise("") for n, p in TAGS]
    return t.symbols.where("name is not null").select("id", F.concat(*parts).alias("tags")).distinct()


@q("exported_rule__X8", r"select distinct s.id, case when regexp_matches(s.file_path, '\.go$') then regexp_matches(s.name, '^[A-Z]') when regexp_matches(s.file_path, '\.py$') then not starts_with(s.name, '_') when regexp_matches(s.file_path, '\.java$') then regexp_matches(s.signature, '\bpublic\b') else regexp_matches(s.signature, '^\s*export\b') end as exported from symbols s where s.name is not null and s.signature is not null")
def exported_rule(t):
    name, sig, path = F.col("name"), F.col("signature"), F.col("file_path")
    rule = F.when(path.endswith(".go"), name.rlike("^[A-Z]")).when(path.endswith(".py"), ~name.startswith("_")).when(path.endswith(".java"), sig.rlike(r"\bpublic\b")).otherwise(sig.rlike(r"^\s*export\b"))
    return t.symbols.where("name is not null and signature is not null").select("id", rule.alias("exported")).distinct()


@q("token_estimate__X9", "select doc_id, cast(ceil(length(text) / 4.0) as int) as tokens, md5(case when length(text) > 400 then substr(text, 1, 400) || '... [truncated]' else text end) as cut from documents")
def token_estimate(t):
    return t.documents.select("doc_id", texts.estimated_tokens(F.col("text")).alias("tokens"), F.md5(texts.truncated(F.col("text"), 100)).alias("cut"))


@q("windows__X10", "with w as (select doc_id, unnest(case when length(text) <= 500 then [0] else range(0, length(text), 400) end) as s, text from documents) select doc_id, cast(s // 400 as int) as piece, md5(substr(text, s + 1, 500)) as hash from w")
def windows(t):
    """Overlapping windows of 500 characters, each 400 after the last."""
    return t.documents.select("doc_id", F.posexplode(texts.windows(F.col("text"), 500, 100)).alias("piece", "part")).select("doc_id", "piece", F.md5("part").alias("hash"))


@q("path_parts__X11", rf"select id, regexp_extract(path, '([^/]*)$', 1) as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as dir, {_EXT} as ext from files")
def path_parts(t):
    p = F.col("path")
    return t.files.select("id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"))


@q("one_line__X12", r"with f as (select id, trim(regexp_replace(content, '\s+', ' ', 'g')) as l from snapshots) select id, case when length(l) > 80 then substr(l, 1, 79) || '…' else l end as line from f")
def one_line(t):
    return t.snapshots.select("id", texts.one_line(F.col("content"), 80).alias("line"))


@q("scrubbed__X13", r"select doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\b(api[_-]?key|token|secret|password)\b(\s*[=:]\s*)\S+', '\1\2***', 'g'), '(/home/|/Users/)[^/\s]+', '\1***', 'g')) as clean from documents")
def scrubbed(t):
    return t.documents.select("doc_id", F.md5(texts.scrubbed(F.col("text"))).alias("clean"))


@q("embed_batches__X20", """
with s as (select doc_id, cast(ceil(length(text) / 4.0) as int) as n from documents)
select doc_id, cast((sum(n) over (order by doc_id) - n) // 35000 as bigint) as batch from s""")
def embed_batches(t):
    """Batches of about 35,000 estimated tokens in id order, by running sums: within ranges first, then across."""
    ranged = t.documents.select("doc_id", texts.estimated_tokens(F.col("text")).alias("n")).repartitionByRange("doc_id").select("doc_id", "n", F.spark_partition_id().alias("part"))
    ranged = cut(ranged)  # both uses must see the same parts
    starts = ranged.groupBy("part").agg(F.sum("n").alias("total")).withColumn("before", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    within = ranged.withColumn("run", F.sum("n").over(Window.partitionBy("part").orderBy("doc_id")))
    return within.join(starts, "part").select("doc_id", F.floor((F.col("before") + F.col("run") - F.col("n")) / 35000).alias("batch"))


@q("stale_by_time__X22", f"select id from runs where finished_at is null and started_at < {NOW} - interval 2 hours")
def stale_by_time(t):
    return t.runs.where(F.expr(f"finished_at is null and started_at < {NOW} - interval 2 hours")).select("id")


@q("heads__X23", "select id, substr(content, 1, 200) as head, length(title) as n from snapshots")
def heads(t):
    return t.snapshots.select("id", F.substring("content", 1, 200).alias("head"), F.length("title").alias("n"))


@q("tag_membership__X24", "select id from snapshots where list_contains(tags, 'log')")
def tag_membership(t):
    return t.snapshots.where(F.array_contains("tags", "log")).select("id")


@q("upserted_files__M1", """
select f.id, coalesce(s.summary, f.summary) as summary, coalesce(s.language, f.language) as language, case when s.id is not null then s.h else f.content_hash end as content_hash
from files f left join (select id, null as summary, lower(language) as language, coalesce(semantic_hash, content_hash) as h from files where semantic_hash is null or semantic_hash <> content_hash) s on f.id = s.id""")
def upserted_files(t):
    """Re-read stale files over the table; summary and language keep old values where the new read has none."""
    old = t.files.select("id", "summary", "language", "content_hash")
    new = t.files.where("semantic_hash is null or semantic_hash <> content_hash").select("id", F.lit(None).cast("string").alias("summary"), F.lower("language").alias("language"), F.coalesce("semantic_hash", "content_hash").alias("content_hash"))
    return merge.upserted(old, new, ["id"], ["summary", "language"])


@q("children_replaced__M2", """
with fresh as (select distinct file_id, name, kind from symbols where kind = 'class')
select file_id, name, kind from (select distinct file_id, name, kind from symbols) where file_id not in (select file_id from fresh) union all select * from fresh""")
def children_replaced(t):
    rows = t.symbols.select("file_id", "name", "kind").distinct()
    return merge.children_replaced(rows, rows.where("kind = 'class'"), ["file_id"])


@q("retry_queue__M3", """
with a as (select vid, count(*) as attempts from vectors where embedding is null or len(embedding) = 0 group by 1),
b as (select distinct vid from vectors where embedding is null or len(embedding) <> 64)
select coalesce(a.vid, b.vid) as vid, coalesce(attempts, 0) + case when b.vid is null then 0 else 1 end as attempts from a full join b on a.vid = b.vid""")
def retry_queue(t):
    empty = F.col("embedding").isNull() | (F.size("embedding") == 0)
    queue = t.vectors.where(empty).groupBy("vid").agg(F.count("*").alias("attempts"))
    return merge.counted_upsert(queue, t.vectors.where(F.col("embedding").isNull() | (F.size("embedding") != 64)), ["vid"])


@q("retry_taken__M4", "select vid from (select vid, count(*) as n from vectors group by 1) where n > 1 order by n desc, vid limit 50")
def retry_taken(t):
    return t.vectors.groupBy("vid").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "vid").limit(50).select("vid")


@q("purged__M5", "select id, project_id from files where project_id not in (select id from projects where contains(name, 'import'))")
def purged(t):
    return t.files.select("id", "project_id").join(t.projects.where(F.contains("name", F.lit("import"))).select(F.col("id").alias("project_id")), "project_id", "left_anti").select("id", "project_id")


@q("note_versions__M6", """
select id, title, cast(row_number() over w as int) as version, created_at as valid_from, lead(created_at) over w as valid_to from snapshots window w as (partition by project_id, title order by created_at, id)""")
def note_versions(t):
    return merge.versioned(t.snapshots, ["project_id", "title"], ["created_at", "id"]).select("id", "title", "version", "valid_from", "valid_to")


@q("runs_abandoned__M7", f"select id, case when status = 'running' and finished_at is null and started_at < {NOW} - interval 2 hours then 'failed' else status end as status from runs")
def runs_abandoned(t):
    stale = F.expr(f"status = 'running' and finished_at is null and started_at < {NOW} - interval 2 hours")
    return t.runs.select("id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"))


@q("models_replaced__M9", """
with seen as (select provider, model, count(*) as calls from costs group by 1, 2), flags as (select provider, model, true as enabled from costs where operation = 'embed' group by 1, 2)
select seen.provider, seen.model, calls, coalesce(enabled, false) as enabled from seen left join flags on seen.provider = flags.provider and seen.model = flags.model""")
def models_replaced(t):
    """Models of a source, user flags carried over."""
    seen = t.costs.groupBy("provider", "model").agg(F.count("*").alias("calls"))
    flags = t.costs.where("operation = 'embed'").select("provider", "model").distinct().withColumn("enabled", F.lit(True))
    return seen.join(flags, ["provider", "model"], "left").select("provider", "model", "calls", F.coalesce("enabled", F.lit(False)).alias("enabled"))
