"""Full-text search: BM25 over any text expression, AND with OR fallback, top-up, grep."""

from __future__ import annotations

import math
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.texts import words

K1, B = 1.2, 0.75
OPERATORS = ("AND", "OR", "NOT", "NEAR")


def query_terms(query: str) -> list[str]:
    """White-space pieces without quotes and bare operators, cut into lower-cased words as documents are; each once."""
    pieces = [p.replace('"', "") for p in query.split()]
    found = [w.lower() for p in pieces if p and p not in OPERATORS for w in re.findall(r"[^\W_]+", p)]
    return list(dict.fromkeys(found))


def _pieces(query: Column) -> Column:
    return F.filter(F.split(F.replace(query, F.lit('"'), F.lit("")), r"\s+"), lambda p: (p != "") & ~p.isin(*OPERATORS))


def title_terms(query: Column) -> Column:
    """query_terms as a column, for tables of queries."""
    return F.array_distinct(words(F.array_join(_pieces(query), " ")))


def title_match(query: Column, connector: str = "AND") -> Column:
    """match_expression as a column."""
    return F.array_join(F.transform(_pieces(query), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), f" {connector} ")


def match_expression(query: str, connector: str = "AND") -> str:
    """Quoted phrases joined by the connector; empty without tokens."""
    pieces = [p.replace('"', "") for p in query.split()]
    return f" {connector} ".join(f'"{p}"' for p in pieces if p and p not in OPERATORS)


def _equals(term: str):
    return lambda word: word == term


def bm25(docs: DataFrame, ident: str, text: Column, query: str, mode: str = "auto", limit: int = 20, keep: Column | None = None, carried: list[str] | None = None) -> DataFrame:
    """(id, hits, score, rank): BM25 of one query over all documents.

    Corpus statistics span all rows; keep filters hits afterwards, before the limit. mode: and, or,
    or auto, which falls back from and to or only if no document has all terms. One pass gathers the
    statistics, one scores; nothing but sums and each task's best limit rows is shuffled. Ties rank by id.
    """
    terms = query_terms(query)
    found = docs.select(F.col(ident).alias("id"), words(text).alias("w"), (keep if keep is not None else F.lit(True)).alias("keep"), *(carried or []))
    counts = [F.size(F.filter("w", _equals(t))).alias(f"tf{k}") for k, t in enumerate(terms)]
    base = found.select("id", "keep", F.size("w").alias("dl"), *counts, *(carried or []))
    if not terms:
        return base.select("id", F.lit(0).alias("hits"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), *(carried or [])).limit(0)
    has = [F.col(f"tf{k}") > 0 for k in range(len(terms))]
    every = F.col("keep")
    for h in has:
        every = every & h
    n, average, whole, *df = base.agg(F.count("*"), F.avg("dl"), F.coalesce(F.bool_or(every), F.lit(False)), *(F.count(F.when(h, 1)) for h in has)).first()
    score = F.lit(0.0)
    for k, seen in enumerate(df):
        tf = F.col(f"tf{k}").cast("double")
        score = score + math.log(1 + (n - seen + 0.5) / (seen + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0)))
    hits = sum((h.cast("int") for h in has), F.lit(0))
    least = len(terms) if mode == "and" or (mode == "auto" and whole) else 1
    scored = base.where("keep").where(hits >= least).select("id", hits.alias("hits"), score.alias("score"), *(carried or []))
    order = (F.desc("score"), F.asc("id"))
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def grep_tokens(pattern: str, literal: bool) -> list[str]:
    """The words a pattern surely contains: escape classes dropped, cut at underscores, three letters or more, the first eight."""
    source = pattern if literal else re.sub(r"\\[dDwWsSbB]", " ", pattern)
    parts = [p.lower() for chunk in re.findall(r"[A-Za-z0-9_]+", source) for p in chunk.split("_") if len(p) >= 3]
    return list(dict.fromkeys(parts))[:8]


def grep(docs: DataFrame, ident: str, text: str, pattern: str, literal: bool = False, case_sensitive: bool = True, limit: int | None = None) -> DataFrame:
    """(id, line_no, line): matching lines, trimmed to 200 characters, documents that hold more of the pattern's words first.

    A pattern that the engine can't compile is taken literally. Lines are split after the row filter, so only documents that
    match at all are exploded.
    """
    if not literal:
        try:
            docs.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException):
            literal = True
    java = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else pattern
    java = java if case_sensitive else f"(?i){java}"
    tokens = grep_tokens(pattern, literal)
    body = F.lower(text)
    likely = sum((F.contains(body, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    found = docs.where(F.col(text).rlike(f"(?m){java}")).select(F.col(ident).alias("id"), likely.alias("likely"), F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    lines = found.where(F.col("raw").rlike(java)).select("likely", "id", (F.col("at") + 1).alias("line_no"), F.substring(F.trim("raw"), 1, 200).alias("line"))
    if limit is not None:
        lines = lines.orderBy(F.desc("likely"), "id", "line_no").limit(limit)
    return lines.drop("likely")


def topped_up(primary: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """primary (id, rank) filled from more, without ids it has, up to limit."""
    rest = more.join(primary.select("id"), "id", "left_anti")
    both = primary.select("id", "rank", F.lit(0).alias("src")).union(rest.select("id", "rank", F.lit(1).alias("src")))
    top = both.orderBy("src", "rank", "id").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy("src", "rank", "id")).alias("rank"))
