"""Problem 6: how often every term occurs, and in how many records, by burst tries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut, slots, table

BURST = 512  # terms in a container from which it bursts into one container per next character
ROUTE_SHARE = 64  # routing prefixes hold at least 1 / (ROUTE_SHARE x partitions) of all entries, which bounds their number

PARTS = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Counters (occurrences, records) of terms: inner nodes by character over compact containers of suffixes."""

    __slots__ = ("children", "here", "container", "limit")

    def __init__(self, limit: int = BURST):
        self.children: dict[str, BurstTrie] | None = None
        self.here: list[int] | None = None  # counters of the term that ends at an inner node
        self.container: dict[str, list[int]] | None = {}
        self.limit = limit

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self, 0
        while node.container is None:
            if at == len(term):
                if node.here is None:
                    node.here = [0, 0]
                node.here[0] += occurrences
                node.here[1] += records
                return
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = BurstTrie(self.limit)
            node, at = child, at + 1
        counters = node.container.get(term[at:])
        if counters is None:
            node.container[term[at:]] = [occurrences, records]
            if len(node.container) > self.limit:
                node._burst()
        else:
            counters[0] += occurrences
            counters[1] += records

    def _burst(self) -> None:
        held, self.container, self.children = self.container, None, {}
        for suffix, counters in held.items():
            if not suffix:
                self.here = counters
                continue
            child = self.children.get(suffix[0])
            if child is None:
                child = self.children[suffix[0]] = BurstTrie(self.limit)
            child.container[suffix[1:]] = counters

    def subtrees(self, prefix: str = "") -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, container) of each leaf, and of each term that ends at an inner node."""
        todo = [(prefix, self)]
        while todo:
            prefix, node = todo.pop()
            if node.container is not None:
                if node.container:
                    yield prefix, node.container
                continue
            if node.here is not None:
                yield prefix, {"": node.here}
            todo += [(prefix + c, child) for c, child in node.children.items()]


def _emit(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for prefix, held in trie.subtrees():
        rows.append((prefix, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()]))
        if len(rows) == 2_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["prefix", "suffixes", "occurrences", "records"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = BurstTrie()
    for b in batches:
        for terms in b.column(0).to_pylist():
            seen: dict[str, int] = {}
            for t in terms or ():
                if t is not None and (t := t.strip().lower()):
                    seen[t] = seen.get(t, 0) + 1
            for t, n in seen.items():
                trie.add(t, n, 1)
    yield from _emit(trie)


def route(term: str, inner: set[str]) -> str:
    """The shortest prefix of term that isn't an inner routing node, or the term."""
    for k in range(len(term) + 1):
        if term[:k] not in inner:
            return term[:k]
    return term


def term_counts(df: DataFrame, terms: str) -> DataFrame:
    """(term, occurrences, records) of every distinct term of an array column.

    Terms are trimmed and lower-cased; null arrays, null terms and blanks count nothing. occurrences
    counts repeats within a record, records doesn't. Every task fills a burst trie and sends compact
    subtrees; prefixes that hold many entries over all tasks become routing nodes, so that a hot
    prefix is spread by its next characters while a hot term is one entry a task. Matching subtrees
    then meet in one task and are merged. Only routing prefixes reach the driver: at most ROUTE_SHARE
    x partitions at each depth. Empty tables give no rows.
    """
    spark = df.sparkSession
    parts = cut(df.select(F.col(terms).cast("array<string>").alias("terms")).where("terms is not null").mapInArrow(_count, PARTS))
    spread = slots(spark)
    total = parts.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0))).first()[0]
    least = max(BURST, total // (ROUTE_SHARE * spread))
    held = parts.select("prefix", F.size("suffixes").cast("bigint").alias("n")).groupBy("prefix").agg(F.sum("n").alias("n"))
    steps = held.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda k: F.substring("prefix", F.lit(1), k))).alias("prefix"), "n")
    inner = {r[0] for r in steps.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("prefix").collect()}
    routes = spark.sparkContext.broadcast(inner)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, tuple[list, list, list]] = {}
            for prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in b.columns)):
                for s, o, r in zip(suffixes, occurrences, records):
                    to = route(prefix + s, routes.value)
                    at = rows.setdefault(to, ([], [], []))
                    at[0].append((prefix + s)[len(to):])
                    at[1].append(o)
                    at[2].append(r)
            if rows:
                yield _batch([(p, *v) for p, v in rows.items()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            for prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in b.columns)):
                for s, o, r in zip(suffixes, occurrences, records):
                    trie.add(prefix + s, o, r)
        yield from _emit(trie)

    merged = parts.mapInArrow(split, PARTS).repartition(spread, "prefix").mapInArrow(merge, PARTS)
    entry = F.explode(F.arrays_zip("suffixes", "occurrences", "records")).alias("e")
    return merged.select("prefix", entry).select(F.concat("prefix", "e.suffixes").alias("term"), F.col("e.occurrences").alias("occurrences"), F.col("e.records").alias("records"))


def term_marks(df: DataFrame, terms: str, rare_records: int = 1, common_share: float = 0.1) -> DataFrame:
    """term_counts with mark: rare in at most rare_records, common in more than common_share of all rows of df, else null."""
    rows = df.count()
    return term_counts(df, terms).withColumn("mark", F.when(F.col("records") > F.lit(common_share) * F.lit(rows), "common").when(F.col("records") <= rare_records, "rare"))


def p6_found(spark, d):
    return term_marks(table(spark, d, "files"), "concepts").where("mark is not null").select(F.col("term").alias("concept"), "mark")


def p6_counts(spark, d):
    return term_marks(table(spark, d, "files"), "concepts").withColumnRenamed("term", "concept")


_SQL = r"""
with each as (select id, lower(regexp_replace(c, '^\s+|\s+$', '', 'g')) as concept from (select id, unnest(concepts) as c from files)),
counted as (select concept, count(*) as occurrences, count(distinct id) as records from each where concept <> '' group by 1),
marked as (select *, case when records > 0.1 * (select count(*) from files) then 'common' when records = 1 then 'rare' end as mark from counted)
"""
QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
SQL = {"p6_found": _SQL + "select concept, mark from marked where mark is not null", "p6_counts": _SQL + "select concept, occurrences, records, mark from marked"}
