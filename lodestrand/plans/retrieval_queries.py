"""Full-text, vector and fused retrieval, scores and the candidate pipeline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import scores, texts, vectors
from lodestrand.operators import fusion, knn, pairs, planner, search
from lodestrand.operators.pipeline import CandidatePipeline, DedupFilter, FixedSource, ScoreColumn, TopKSelector
from lodestrand.operators.postings import index_of
from lodestrand.plans.registry import Registry

R = Registry()
q = R.add

QUESTION, TOPIC = "session layer", "throttle queue planner"


def _documents(t):
    return index_of(t.documents, "doc_id", F.col("text"), f"{t.sf_dir}/documents")


def bm25_sql(table: str, ident: str, text: str, query: str, mode: str, limit: int | None, keep: str = "true") -> str:
    """The same BM25 over tokens in plain SQL: a common table expression named ranked (id, hits, score, rank)."""
    terms = search.query_terms(query)
    listed = ", ".join(f"'{t}'" for t in terms)
    need = f"where hits = {len(terms)}" if mode == "and" else f"where hits = {len(terms)} or (select max(hits) from scored) < {len(terms)}" if mode == "auto" else ""
    cut = f"where rank <= {limit}" if limit else ""
    return rf"""
docs as (select {ident} as id, {keep} as keep, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') as w from {table}),
stats as (select count(*) as n, avg(len(coalesce(w, []))) as avgdl from docs),
tf as (select id, keep, term, count(*) as tf, any_value(dl) as dl from (select id, keep, len(w) as dl, unnest(w) as term from docs) where term in ({listed}) group by 1, 2, 3),
idf as (select term, ln(1 + ((select n from stats) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf group by 1),
scored as (select id, cast(count(*) as int) as hits, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (select avgdl from stats)))) as score from tf join idf using (term) where keep group by 1),
kept as (select * from scored {need}),
ranked as (select * from (select id, hits, score, cast(row_number() over (order by round(score, 10) desc, id) as int) as rank from kept) {cut})"""


@q("bm25_documents__F4t", "with" + bm25_sql("documents", "doc_id", "text", QUESTION, "auto", 20) + " select id, hits, round(score, 6) as score, rank from ranked")
def bm25_documents(t):
    return _documents(t).search(QUESTION, "auto", 20).withColumn("score", F.round("score", 6))


@q("bm25_scanned__F4s", "with" + bm25_sql("documents", "doc_id", "text", QUESTION, "auto", 20) + " select id, hits, round(score, 6) as score, rank from ranked")
def bm25_scanned(t):
    """The same without an index, by a scan."""
    return search.bm25(t.documents, "doc_id", F.col("text"), QUESTION, "auto", 20).withColumn("score", F.round("score", 6))


@q("indexed_terms__J1", r"select term, count(distinct doc_id) as docs, count(*) as occurrences from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents) group by 1")
def indexed_terms(t):
    """What the stored index of documents holds of each term."""
    return _documents(t).counts()


@q("missing_postings__S24", r"select id from files where summary is null or len(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+')) = 0")
def missing_postings(t):
    """Files without a posting in the index of summaries."""
    return index_of(t.files, "id", F.col("summary"), f"{t.sf_dir}/summaries").unindexed(t.files, "id")


_FILE_TEXT = "concat_ws(' ', path, summary, array_to_string(concepts, ' '))"


@q("bm25_files__F7t", "with" + bm25_sql("files", "id", _FILE_TEXT, "shard cache", "or", 20, "project_id > 5") + " select id, hits, round(score, 6) as score, rank from ranked")
def bm25_files(t):
    """Statistics span all projects, the project filter comes before the limit."""
    text = F.concat_ws(" ", "path", "summary", F.array_join("concepts", " "))
    return index_of(t.files, "id", text, f"{t.sf_dir}/files").search("shard cache", "or", 20, t.files.where("project_id > 5").select("id")).withColumn("score", F.round("score", 6))


@q("fallback_or__F5t", "with" + bm25_sql("snapshots", "id", "concat_ws(' ', title, content)", "heartbeat nosuchwordhere", "auto", 20) + " select id, hits, rank from ranked")
def fallback_or(t):
    return search.bm25(t.snapshots, "id", F.concat_ws(" ", "title", "content"), "heartbeat nosuchwordhere", "auto", 20).select("id", "hits", "rank")


# Titles of notes are taken as queries: each is cut into its terms, made a match expression and planned.
_PIECES = r"list_filter(string_split_regex(replace(title, chr(34), ''), '\s+'), lambda p: p <> '' and p not in ('AND', 'OR', 'NOT', 'NEAR'))"


@q("query_terms__F1t", rf"select id, unnest(list_distinct(regexp_extract_all(lower(array_to_string({_PIECES}, ' ')), '[\p{{L}}\p{{N}}]+'))) as term from snapshots where title is not null")
def query_terms(t):
    return t.snapshots.where("title is not null").select("id", F.explode(search.title_terms(F.col("title"))).alias("term"))


@q("match_expressions__F2t", rf"select id, array_to_string(list_transform({_PIECES}, lambda p: chr(34) || p || chr(34)), ' AND ') as strict, array_to_string(list_transform({_PIECES}, lambda p: chr(34) || p || chr(34)), ' OR ') as loose from snapshots where title is not null")
def match_expressions(t):
    return t.snapshots.where("title is not null").select("id", *(search.title_match(F.col("title"), c).alias(n) for c, n in (("AND", "strict"), ("OR", "loose"))))


@q("tokens__F3t", r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as n, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as terms from documents")
def tokens(t):
    w = texts.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("terms"))


@q("rank_scores__F6t", "select id, round(1 / (1 + log2(rank)), 3) as score from (select id, row_number() over (order by size desc, id) as rank from files) where rank <= 50")
def rank_scores(t):
    top = t.files.orderBy(F.desc("size"), "id").limit(50).select("id", F.row_number().over(Window.orderBy(F.desc("size"), "id")).alias("rank"))
    return top.select("id", scores.rank_score(F.col("rank")).alias("score"))


@q("topped_up__F8t", "with" + bm25_sql("files", "id", "summary", "funnel", "or", 5) + """, more as (select c.file_id as id, row_number() over (order by c.file_id) as rank from file_contents c where contains(c.content, 'funnel')),
merged as (select id, rank, 0 as src from ranked union all select id, rank, 1 from more where id not in (select id from ranked))
select id, cast(row_number() over (order by src, rank, id) as int) as rank from merged qualify row_number() over (order by src, rank, id) <= 30""")
def topped_up(t):
    """Hits in summaries, filled up from hits in contents."""
    first = search.bm25(t.files, "id", F.col("summary"), "funnel", "or", 5).select("id", "rank")
    more = t.file_contents.where(F.contains("content", F.lit("funnel"))).select(F.col("file_id").alias("id")).orderBy("id").limit(60)
    return search.topped_up(first, more.withColumn("rank", F.row_number().over(Window.orderBy("id"))), 30)


@q("grep_tokens__F9t", "select distinct name, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9_]+', '_', 'g'), '_'), lambda p: length(p) >= 3))) as tokens from symbols where name is not null")
def grep_tokens(t):
    """The words that a search for each symbol's name surely needs."""
    pieces = F.split(F.regexp_replace(F.lower("name"), "[^a-z0-9_]+", "_"), "_")
    return t.symbols.where("name is not null").select("name", F.array_sort(F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= 3))).alias("tokens")).distinct()


@q("prefix_terms__F10t", r"select file_id, count(*) as n from (select file_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) as w from file_contents) where starts_with(w, 'throttle') group by 1")
def prefix_terms(t):
    hits = F.size(F.filter(texts.words(F.col("content")), lambda w: w.startswith("throttle")))
    return t.file_contents.select("file_id", hits.cast("bigint").alias("n")).where("n > 0")


@q("grep__F11t", r"select file_id as id, cast(i as int) as line_no, substr(trim(l), 1, 200) as line from (select file_id, unnest(string_split(content, chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1) as i from file_contents) where regexp_matches(l, 'throttle\w*\(')")
def grep(t):
    return search.grep(t.file_contents, "file_id", "content", r"throttle\w*\(")


@q("grep_literal__S11", r"select file_id as id, cast(i as int) as line_no, substr(trim(l), 1, 200) as line from (select file_id, unnest(string_split(content, chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1) as i from file_contents) where contains(l, 'TODO(')")
def grep_literal(t):
    """An invalid expression is taken literally."""
    return search.grep(t.file_contents, "file_id", "content", "TODO(")


@q("notes_hybrid__F12t", "with" + bm25_sql("snapshots", "id", "concat_ws(' ', title, content)", "heartbeat", "or", 40, "archived_at is null") + """,
imp as (select id, cast(row_number() over (order by importance desc, id) as int) as rank from snapshots where archived_at is null and importance is not null qualify row_number() over (order by importance desc, id) <= 40),
lists as (select 0 as src, id, rank from ranked union all select 1, id, rank from imp)
select id, round(sum(1.0 / (60 + rank)), 9) as score from lists group by 1 order by 2 desc, id limit 10""")
def notes_hybrid(t):
    """BM25 over notes fused with their importance, archived ones left out."""
    text = search.bm25(t.snapshots, "id", F.concat_ws(" ", "title", "content"), "heartbeat", "or", 40, keep=F.col("archived_at").isNull()).select("id", "rank")
    best = t.snapshots.where("archived_at is null and importance is not null").orderBy(F.desc("importance"), "id").limit(40)
    best = best.select("id", F.row_number().over(Window.orderBy(F.desc("importance"), "id")).alias("rank"))
    lists = text.select(F.lit(0).alias("source_ord"), F.col("id").alias("candidate"), "rank").union(best.select(F.lit(1), "id", "rank"))
    fused = fusion.rrf(lists)
    return fused.select(F.col("candidate").alias("id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(10)


# ---- vectors. The embeddings table is joined with one stated query vector: a single broadcast row.


def _asked(t, ident: int):
    return t.embeddings.where(F.col("vec_id") == ident).select(F.col("embedding").alias("asked"))


def _pairs_with(t, ident: int):
    rows = _asked(t, ident).limit(1).collect()
    asked = F.array(*(F.lit(float(x)) for x in rows[0][0])) if rows else F.array().cast("array<double>")
    return t.embeddings.select("vec_id", "label", "embedding", asked.alias("asked"))


_E = "list_transform(embedding, lambda x: cast(x as double))"
_ASK = "(select list_transform(embedding, lambda x: cast(x as double)) from embeddings where vec_id = 7)"


@q("knn_l2__V1", f"select vec_id, round(list_distance({_E}, {_ASK}), 6) as distance, round(1 / (1 + list_distance({_E}, {_ASK})), 6) as score from embeddings where label is not null order by list_distance({_E}, {_ASK}), vec_id limit 15")
def knn_l2(t):
    d = vectors.l2(F.col("embedding"), F.col("asked"))
    top = _pairs_with(t, 7).where("label is not null").select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(15)
    return top.select("vec_id", F.round("d", 6).alias("distance"), F.round(vectors.distance_score(F.col("d")), 6).alias("score"))


_MANY = f"e as (select vec_id, label, {_E} as v from embeddings), o as (select vec_id as asked, v as w from e where vec_id % 50 = 0)"


@q("knn_l2_many__V1q", f"with {_MANY} select asked, vec_id, round(list_distance(v, w), 6) as distance, cast(row_number() over (partition by asked order by list_distance(v, w), vec_id) as int) as rank from e, o where label is not null qualify rank <= 15")
def knn_l2_many(t):
    """The search of V1 for every vector whose id is divisible by 50."""
    found = knn.nearest_rows(t.embeddings.where("label is not null"), t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 15)
    return found.select("asked", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@q("cosines__V2", f"select vec_id, round(list_cosine_similarity({_E}, {_ASK}), 6) as cosine from embeddings")
def cosines(t):
    return _pairs_with(t, 7).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("asked")), 6).alias("cosine"))


@q("dots__V3", f"select vec_id, round(list_inner_product({_E}, {_ASK}), 6) as dot from embeddings")
def dots(t):
    return _pairs_with(t, 7).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("asked")), 6).alias("dot"))


@q("normalised__V4", f"select vec_id, round(sqrt(list_inner_product({_E}, {_E})), 6) as norm, 1.0 as unit from embeddings")
def normalised(t):
    return t.embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 6).alias("unit"))


_PLANES = vectors.hyperplanes(64)
_BITS = " + ".join("case when list_inner_product({}, [{}]) > 0 then {} else 0 end".format(_E, ", ".join(f"cast({x!r} as double)" for x in p), 1 << b) for b, p in enumerate(_PLANES))
_SIG = f"sig as (select vec_id, label, cast({_BITS} as bigint) as signature from embeddings)"
_SCALES = vectors.bucket_scales()
_BUCKETS = [f"xor((signature >> {(j * 12) % 32}) & 4095, {s & 4095}) % 4095 + 1" for j, s in enumerate(_SCALES)]


@q("simhash__V7", f"with {_SIG} select vec_id, signature from sig")
def simhash(t):
    return t.embeddings.select("vec_id", vectors.simhash(F.col("embedding"), _PLANES).alias("signature"))


@q("hamming__V8", f"with {_SIG}, o as (select signature as s from sig where vec_id = 7) select vec_id, cast(bit_count(xor(signature, s)) as int) as distance, round(cos(pi() * bit_count(xor(signature, s)) / 32), 6) as estimate from sig, o")
def hamming(t):
    signed = simhash(t)
    own = signed.where("vec_id = 7").first()
    d = vectors.hamming(F.col("signature"), F.lit(own[1] if own else 0).cast("bigint"))
    return signed.select("vec_id", d.alias("distance"), F.round(vectors.hamming_cosine(d), 6).alias("estimate"))


@q("hamming_many__V8q", f"with {_SIG}, o as (select vec_id as asked, signature as s from sig where vec_id % 50 = 0) select asked, vec_id, cast(bit_count(xor(signature, s)) as int) as distance, round(cos(pi() * bit_count(xor(signature, s)) / 32), 6) as estimate from sig, o qualify row_number() over (partition by asked order by bit_count(xor(signature, s)), vec_id) <= 15")
def hamming_many(t):
    """The 15 rows of least Hamming distance to every vector whose id is divisible by 50; between bits it is the squared distance."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(vectors.PLANES - 1)), lambda b: F.call_function("getbit", F.col("signature"), b))
    signed = simhash(t).where("signature is not null").select("vec_id", bits.alias("bits"))
    found = knn.nearest_rows(signed, signed.where("vec_id % 50 = 0"), "vec_id", "bits", 15)
    d = F.round(F.col("distance") * F.col("distance")).cast("int")
    return found.select("asked", F.col("id").alias("vec_id"), d.alias("distance"), F.round(vectors.hamming_cosine(d), 6).alias("estimate"))


@q("buckets__V11", f"with {_SIG} select vec_id, cast({_BUCKETS[0]} as int) as first, cast({_BUCKETS[1]} as int) as second from sig")
def buckets(t):
    b = vectors.buckets(F.col("signature"))
    return simhash(t).select("vec_id", b[0].alias("first"), b[1].alias("second"))


@q("bucket_sizes__V12", f"with {_SIG}, b as (select 0 as h, {_BUCKETS[0]} as bucket from sig union all select 1, {_BUCKETS[1]} from sig) select cast(h as int) as h, cast(bucket as int) as bucket, count(*) as n from b group by 1, 2 having count(*) > 1")
def bucket_sizes(t):
    """Rows that share a bucket: the candidates of the near-duplicate join, counted before any pairing."""
    each = simhash(t).select(F.posexplode(vectors.buckets(F.col("signature"))).alias("h", "bucket"))
    return each.groupBy("h", "bucket").agg(F.count("*").alias("n")).where("n > 1")


_NEAR = f"""with recursive {_SIG}, b as (select 0 as h, {_BUCKETS[0]} as bucket, vec_id from sig union all select 1, {_BUCKETS[1]}, vec_id from sig),
e as (select vec_id, {_E} as v from embeddings),
links as (select distinct x.vec_id as a, y.vec_id as b from b x join b y on x.h = y.h and x.bucket = y.bucket and x.vec_id <> y.vec_id join e ex on ex.vec_id = x.vec_id join e ey on ey.vec_id = y.vec_id where list_cosine_similarity(ex.v, ey.v) >= 0.5),
walk(node, other) as (select vec_id, vec_id from embeddings union select w.node, l.b from walk w join links l on l.a = w.other)
select node as vec_id, min(other) as class_id, coalesce(any_value(n), 0) as links from walk left join (select a, count(*) as n from links group by 1) on a = node group by 1"""


@q("near_duplicates__V12b", _NEAR)
def near_duplicates(t):
    """Rows that share a bucket, verified by their cosine: class and number of links of every vector."""
    return pairs.near_duplicate_vectors(t.embeddings, "vec_id", "embedding", _PLANES, 0.5)


_KINDS = """v as (select type, try_cast(ref_id as bigint) as ref, min(vid) as vid from vectors where type in ('symbol_body', 'symbol') and len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: isnan(x)), true) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 and try_cast(ref_id as bigint) is not null group by 1, 2),
w as (select distinct v.type, ref, list_transform(embedding, lambda x: cast(x as double)) as e from v join vectors using (vid) where vectors.embedding is not null),
one as (select type, ref, min(e) as e from w group by 1, 2),
asked as (select ref, case when bool_or(type = 'symbol_body') then 'symbol_body' else 'symbol' end as type from one where ref % 50 = 0 group by 1)"""


@q("semantic_neighbours__V13", f"with {_KINDS} select a.ref as asked, o.ref as neighbour, a.type, round(list_distance(o.e, s.e), 6) as distance from asked a join one s on s.ref = a.ref and s.type = a.type join one o on o.type = a.type and o.ref <> a.ref qualify row_number() over (partition by a.ref order by list_distance(o.e, s.e), o.ref) <= 5")
def semantic_neighbours(t):
    """The 5 symbols most like each whose id is divisible by 50: by bodies where it has one, else by signatures; itself dropped."""
    fine = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: ~F.isnan(x)) & (F.size("embedding") == 64)
    rows = t.vectors.where(F.col("type").isin("symbol_body", "symbol")).where(fine).select("type", F.expr("try_cast(ref_id as bigint)").alias("ref"), "vid", "embedding").where("ref is not null")
    one = rows.groupBy("type", "ref").agg(F.min(F.struct("vid", "embedding")).alias("m")).select("type", "ref", F.col("m.embedding").alias("embedding"))
    bodies, signatures = one.where("type = 'symbol_body'"), one.where("type = 'symbol'")
    stated = lambda df: df.where("ref % 50 = 0")
    found = None
    for kind, held, asked in (("symbol_body", bodies, stated(bodies)), ("symbol", signatures, stated(signatures).join(bodies.select("ref"), "ref", "left_anti"))):
        near = knn.nearest_rows(held, asked, "ref", "embedding", 6).where("asked <> id").select("asked", F.col("id").alias("neighbour"), F.lit(kind).alias("type"), "distance")
        found = near if found is None else found.union(near)
    best = Window.partitionBy("asked").orderBy("distance", "neighbour")
    return found.withColumn("_at", F.row_number().over(best)).where("_at <= 5").select("asked", "neighbour", "type", F.round("distance", 6).alias("distance"))


@q("variants_fused__V14", f"""with e as (select vec_id, {_E} as v from embeddings), a as (select x.vec_id as query, d as variant, y.v as w from e x, (values (0), (1), (2)) n(d), e y where x.vec_id % 50 = 0 and y.vec_id = x.vec_id + d),
lists as (select query, variant, e.vec_id, row_number() over (partition by query, variant order by list_distance(v, w), e.vec_id) as rank from a, e qualify rank <= 20)
select query, vec_id, round(sum(1.0 / (60 + rank)), 9) as score from lists group by 1, 2""")
def variants_fused(t):
    """For every query, a vector whose id is divisible by 50: nearest vectors of three variants, it and the two after it, fused by reciprocal ranks."""
    asked = t.embeddings.where("vec_id % 50 in (0, 1, 2)")
    near = knn.nearest_rows(t.embeddings, asked, "vec_id", "embedding", 20).select((F.col("asked") - F.col("asked") % 50).alias("query"), (F.col("asked") % 50).cast("int").alias("source_ord"), F.col("id").alias("candidate"), "rank")
    return fusion.rrf(near, by="query").select("query", F.col("candidate").alias("vec_id"), F.round("score", 9).alias("score"))


_TOPIC = r"trim(regexp_replace(trim(regexp_replace(trim(title), '^(how\s+(?:does|do|is|are|can|to)|what\s+(?:is|does|are)|where\s+(?:is|does|are)|why\s+(?:is|does|are))\s+', '', 'i')), '\?+$', ''))"


@q("query_variants__V15", rf"""with q as (select id, trim(title) as title, {_TOPIC} as topic from snapshots where title is not null)
select distinct id, unnest(case when topic in ('', title) then [title, title || ' implementation'] else [title, 'implementation of ' || topic, 'function class ' || topic] end) as variant from q""")
def query_variants(t):
    """The variants of each note's title, taken as a query."""

    @F.pandas_udf("array<string>")
    def made(batch: pd.Series) -> pd.Series:
        return batch.map(planner.variants)

    return t.snapshots.where("title is not null").select("id", F.explode(made("title")).alias("variant")).distinct()


# ---- fusion and scores

_HYBRID = ("with" + bm25_sql("documents", "doc_id", "text", TOPIC, "or", 60) + f""",
vec as (select vec_id as id, cast(row_number() over (order by list_distance({_E}, {_ASK}), vec_id) as int) as rank from embeddings qualify rank <= 60),
lists as (select 0 as src, id, rank from ranked union all select 1, id, rank from vec),
fused as (select id, sum(1.0 / (60 + rank)) as score, min(row(src, rank)) as seen, min(case when src = 0 then rank end) as fts_rank, min(case when src = 1 then rank end) as vec_rank from lists group by 1)
select id, round(score, 9) as score, fts_rank, vec_rank, cast(row_number() over (order by round(score, 12) desc, seen, id) as int) as rank from fused qualify rank <= 20""")


@q("hybrid_search__R4", _HYBRID)
def hybrid_search(t, query: str = TOPIC, near: int = 7, limit: int = 20):
    """BM25 over documents fused with the vectors nearest to a given one; each stream is fetched three times the limit deep."""
    text = _documents(t).search(query, "or", 3 * limit).select(F.col("id").alias("candidate"), "rank")
    top = _pairs_with(t, near).select("vec_id", vectors.l2(F.col("embedding"), F.col("asked")).alias("d")).orderBy("d", "vec_id").limit(3 * limit)
    vec = top.select(F.col("vec_id").alias("candidate"), F.row_number().over(Window.orderBy("d", "vec_id")).alias("rank"))
    lists = text.select(F.lit(0).alias("source_ord"), "candidate", "rank").union(vec.select(F.lit(1), "candidate", "rank"))
    own = lists.groupBy("candidate").agg(F.min(F.when(F.col("source_ord") == 0, F.col("rank"))).alias("fts_rank"), F.min(F.when(F.col("source_ord") == 1, F.col("rank"))).alias("vec_rank"))
    fused = fusion.rrf(lists, limit=limit).join(own, "candidate")
    return fused.select(F.col("candidate").alias("id"), F.round("score", 9).alias("score"), "fts_rank", "vec_rank", "rank")


_ASKED = "how does the throttle queue work?"
_EXPANDED = " union all ".join(f"select {n} as src, id, rank from (with {bm25_sql('documents', 'doc_id', 'text', v, 'or', 60)} select id, rank from ranked)" for n, v in enumerate(planner.variants(_ASKED)))


@q("expanded_search__R5", f"with vec as (select vec_id as id, cast(row_number() over (order by list_distance({_E}, {_ASK}), vec_id) as int) as rank from embeddings qualify rank <= 60), lists as ({_EXPANDED} union all select 9, id, rank from vec) select id, round(sum(1.0 / (60 + rank)), 9) as score from lists group by 1")
def expanded_search(t):
    """Words of every variant of a question and the vectors nearest to a given one, fused."""
    top = _pairs_with(t, 7).select("vec_id", vectors.l2(F.col("embedding"), F.col("asked")).alias("d")).orderBy("d", "vec_id").limit(60)
    lists = top.select(F.lit(9).alias("source_ord"), F.col("vec_id").alias("candidate"), F.row_number().over(Window.orderBy("d", "vec_id")).alias("rank"))
    for n, variant in enumerate(planner.variants(_ASKED)):
        lists = lists.union(_documents(t).search(variant, "or", 60).select(F.lit(n), "id", "rank"))
    return fusion.rrf(lists).select(F.col("candidate").alias("id"), F.round("score", 9).alias("score"))


@q("rrf_by_project__R1", """
with lists as (select 0 as src, id, project_id, row_number() over (partition by project_id order by size desc, id) as rank from files union all select 1, id, project_id, row_number() over (partition by project_id order by updated_at desc, id) from files)
select project_id, id, round(sum(1.0 / (60 + rank)), 9) as score from lists where rank <= 20 group by 1, 2""")
def rrf_by_project(t):
    by = lambda n, *o: t.files.select(F.lit(n).alias("source_ord"), F.col("id").alias("candidate"), "project_id", F.row_number().over(Window.partitionBy("project_id").orderBy(*o)).alias("rank")).where("rank <= 20")
    lists = by(0, F.desc("size"), "id").union(by(1, F.desc("updated_at"), "id"))
    return fusion.rrf(lists, by="project_id").select("project_id", F.col("candidate").alias("id"), F.round("score", 9).alias("score"))


_WORDS_OF = r"list_filter(string_split_regex(trim(title), '\s+'), lambda w: w <> '')"
_PLANS = rf"""with q as (select id, trim(title) as s, {_WORDS_OF} as w from snapshots where title is not null)
select id, case when s = '' then 'empty query' when regexp_full_match(s, '[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*|[A-Za-z_$][\w$]*::[A-Za-z_$][\w$]*') then 'identifier-shaped query'
when regexp_matches(s, '\?$|^(how|why|what|where|when|which|como|por\s*que|onde|quando|qual)\b', 'i') then 'question phrasing'
when len(w) <= 4 and len(list_filter(w, lambda x: not regexp_full_match(x, '[A-Za-z_$][\w$.-]*'))) = 0 then 'short code-shaped tokens'
when len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in planner.STOPWORDS)}))) >= 2 or len(w) > 6 then 'natural-language query' else 'short mixed query' end as reason from q"""


@q("plans__R3", f"select id, reason, case when reason in ('question phrasing', 'natural-language query') then 'hybrid' else 'fts' end as mode from ({_PLANS})")
def plans(t):
    """The retrieval mode of each note's title, taken as a query."""
    return t.snapshots.where("title is not null").select("id", planner.planned(F.col("title")).alias("p")).select("id", "p.mode", "p.reason")


@q("weighted_sums__R7", "select id, round(case when c < 0 then (c + 1) / 3.5 else c + 1 end, 9) as score from (select id, coalesce(importance, 0) * 2 + case when archived_at is null then 0.0 else -1.0 end + 0.5 * len(tags) as c from snapshots)")
def weighted_sums(t):
    parts = [(F.col("importance"), 2.0), (F.when(F.col("archived_at").isNull(), 0.0).otherwise(1.0), -1.0), (F.size("tags").cast("double"), 0.5)]
    return t.snapshots.select("id", F.round(scores.weighted_sum(parts), 9).alias("score"))


@q("recency__R8", "select id, round(power(2, -greatest(0, date_diff('second', created_at, timestamp '2026-01-01')) / 86400.0 / 30), 9) as score from snapshots")
def recency(t):
    age = F.expr("(unix_seconds(timestamp '2026-01-01 00:00:00') - unix_seconds(cast(created_at as timestamp))) / 86400.0D")
    return t.snapshots.select("id", F.round(scores.recency(age, 30.0), 9).alias("score"))


@q("frequency__R9", "select p.id, round(least(1.0, coalesce(n, 0) / 5.0), 6) as boost from projects p left join (select project_id, count(*) as n from costs where created_at >= timestamp '2025-12-28' and created_at < timestamp '2026-01-01' group by 1) c on c.project_id = p.id")
def frequency(t):
    seen = t.costs.where("created_at >= timestamp '2025-12-28' and created_at < timestamp '2026-01-01'").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"))
    return t.projects.select("id").join(seen, "id", "left").select("id", F.round(scores.frequency(F.col("n")), 6).alias("boost"))


_SHARE = r"len(list_filter(['throttle', 'queue', 'planner'], lambda x: list_contains(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), x))) / 3.0"


@q("cached_scores__R10", rf"select id, round({_SHARE.format('summary')}, 6) as score, coalesce(semantic_hash = content_hash, false) as hit from files where summary is not null")
def cached_scores(t):
    """Scores of a query and file kept under the file's hash: files whose kept hash still holds are read from the cache, the rest are scored."""
    share = lambda c: F.round(scores.share_of_terms(texts.words(c), search.query_terms(TOPIC)), 6)
    rows = t.files.where("summary is not null").select("id", "summary", F.col("content_hash").alias("state"))
    cache = t.files.where("summary is not null and semantic_hash is not null").select("id", F.col("semantic_hash").alias("state"), share(F.col("summary")).alias("cached"))
    found = rows.join(cache, ["id", "state"], "left")
    return found.select("id", F.coalesce("cached", share(F.col("summary"))).alias("score"), F.col("cached").isNotNull().alias("hit"))


_RERANK = "with" + bm25_sql("documents", "doc_id", "text", TOPIC, "or", 40)


@q("reranked__R13", _RERANK + f" select r.id, round({_SHARE.format('text')}, 6) as relevance, rank from ranked r join documents on doc_id = r.id order by {_SHARE.format('text')} desc, rank limit 10")
def reranked(t):
    """BM25 hits rescored, here by the share of query words in the whole text; ties keep the order."""
    hits = search.bm25(t.documents, "doc_id", F.col("text"), TOPIC, "or", 40, carried=["text"])
    scored = hits.withColumn("relevance", scores.share_of_terms(texts.words(F.col("text")), search.query_terms(TOPIC))).orderBy(F.desc("relevance"), "rank").limit(10)
    return scored.select("id", F.round("relevance", 6).alias("relevance"), "rank")


@q("rerank_texts__R14", "select id, concat_ws(chr(10), path, summary, array_to_string(concepts, ' ')) as doc from files")
def rerank_texts(t):
    return t.files.select("id", F.concat_ws("\n", "path", "summary", F.array_join("concepts", " ")).alias("doc"))


@q("action_fusion__R15", "select id, round(coalesce(importance, 0) + 0.4 * least(1.0, len(tags) / 3.0) + 0.2 * case when archived_at is null then 1 else 0 end, 9) as score from snapshots")
def action_fusion(t):
    actions = F.create_map(F.lit("relevance"), F.coalesce("importance", F.lit(0.0)), F.lit("scope_match"), F.least(F.lit(1.0), F.size("tags") / 3.0), F.lit("freshness"), F.when(F.col("archived_at").isNull(), 1.0).otherwise(0.0))
    return t.snapshots.select("id", F.round(scores.action_score(actions), 9).alias("score"))


@q("recent_scores__R16", "select id, round(power(2, -date_diff('second', updated_at, timestamp '2026-01-01') / 86400.0 / 30) * (0.4 + 0.6 * case when contains(lower(path), 'cache') then 1 else 0 end) + case when is_test then 0.1 else 0 end, 9) as score from files where updated_at <= timestamp '2026-01-01'")
def recent_scores(t):
    age = F.expr("(unix_seconds(timestamp '2026-01-01 00:00:00') - unix_seconds(cast(updated_at as timestamp))) / 86400.0D")
    matched = F.contains(F.lower("path"), F.lit("cache")).cast("int")
    return t.files.where("updated_at <= timestamp '2026-01-01'").select("id", F.round(scores.recent_file(scores.recency(age, 30.0), matched, F.col("is_test")), 9).alias("score"))


@q("pipeline__R17", """
with c as (select id, coalesce(importance, 0) as importance, project_id from snapshots where archived_at is null union all select id, 0, project_id from files where is_test),
d as (select id, max(importance) as importance from c group by 1)
select id, round(importance * 2, 6) as score from d order by importance desc, id limit 25""")
def pipeline(t):
    """Two sources, a filter, a scorer and a selector, staged by the candidate pipeline."""
    notes = t.snapshots.where("archived_at is null").select("id", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    tests = t.files.where("is_test").select("id", F.lit(0.0).alias("importance"))
    stages = CandidatePipeline(sources=[FixedSource("notes", notes), FixedSource("tests", tests)], filters=[DedupFilter("id", best="importance")], scorers=[ScoreColumn("score", F.col("importance") * 2)], selector=TopKSelector("score", "id", 25))
    return stages.execute().selected.select("id", F.round("score", 6).alias("score"))
