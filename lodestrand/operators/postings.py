"""A stored full-text index: postings by term, document lengths and corpus sums; BM25 that reads only its terms."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Hashable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.texts import words
from lodestrand.operators.search import K1, B, query_terms
from lodestrand.session import shared_folder

BUCKETS = 64  # folders that terms are spread over; a query opens those of its terms


SCHEMAS = {"postings": "term string, id bigint, tf bigint, dl bigint, bucket int", "terms": "term string, docs bigint, bucket int", "lengths": "id bigint, dl bigint", "sums": "n bigint, total bigint"}


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")  # a hash that the driver has, too


@dataclass
class PostingsIndex:
    """Generations g0, g1 ... in a folder, each with postings (term, id, tf, dl) and terms (term, docs) by bucket of the term, lengths (id, dl) and sums (n, total).

    Within a bucket rows are sorted by term, so that a filter on terms skips most of each file. Every
    document has a length, also one without words. A generation's sums are written last; one without
    them was left unfinished, isn't read and is written anew.
    """

    spark: SparkSession
    folder: str
    _sums: tuple[int, int] | None = field(default=None, repr=False)

    @staticmethod
    def build(docs: DataFrame, ident: str, text: Column, folder: str) -> PostingsIndex:
        """Index text of every row with an id; rows of one id are one document. Building again gives the same index."""
        index = PostingsIndex(docs.sparkSession, folder)
        fs, path = index._place("")
        fs.delete(path, True)
        index._write(docs.select(F.col(ident).cast("bigint").alias("id"), words(text).alias("w")).where("id is not null"), 0)
        return index

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _generations(self) -> list[int]:
        found: list[int] = []
        while True:
            fs, path = self._place(f"g{len(found)}/sums/_SUCCESS")
            if not fs.exists(path):
                return found
            found.append(len(found))

    def _write(self, held: DataFrame, number: int) -> None:
        to = f"{self.folder}/g{number}"
        read = lambda name: self.spark.read.schema(SCHEMAS[name]).parquet(f"{to}/{name}")
        held.groupBy("id").agg(F.sum(F.size("w")).cast("bigint").alias("dl")).write.mode("overwrite").parquet(f"{to}/lengths")
        counted = held.select("id", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
        placed = counted.join(read("lengths"), "id").select("term", "id", "tf", "dl", _bucket(F.col("term")).alias("bucket"))
        placed.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/postings")
        terms = read("postings").groupBy("bucket", "term").agg(F.count("*").alias("docs"))
        terms.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/terms")
        read("lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{to}/sums")
        self._sums = None

    def _table(self, name: str) -> DataFrame:
        each = [self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/g{k}/{name}") for k in self._generations()]
        return functools.reduce(DataFrame.union, each)

    def sums(self) -> tuple[int, int]:
        if self._sums is None:
            self._sums = tuple(self._table("sums").agg(F.sum("n"), F.sum("total")).first())
        return self._sums

    def _of_terms(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of terms; only the folders of their buckets are listed and opened."""
        asked = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        folders = []
        for k in self._generations():
            for b in asked:
                fs, path = self._place(f"g{k}/{name}/bucket={b}")
                if fs.exists(path):
                    folders.append(path.toString())
        schema = SCHEMAS[name].removesuffix(", bucket int")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).where(F.col("term").isin(terms))

    def counts(self) -> DataFrame:
        """(term, docs, occurrences) of every term."""
        return self._table("postings").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))

    def unindexed(self, docs: DataFrame, ident: str) -> DataFrame:
        """(id): rows of docs without a posting."""
        return docs.select(F.col(ident).cast("bigint").alias("id")).join(self._table("postings").select("id").distinct(), "id", "left_anti")

    def repair(self, docs: DataFrame, ident: str, text: Column) -> int:
        """Index the documents that the index lacks, as a further generation; how many. Doing so again adds nothing."""
        missing = docs.select(F.col(ident).cast("bigint").alias("id"), words(text).alias("w")).where("id is not null").join(self._table("lengths"), "id", "left_anti")
        n = missing.select("id").distinct().count()
        if n:
            self._write(missing, len(self._generations()))
        return n

    def search(self, query: str, mode: str = "auto", limit: int = 20, scope: DataFrame | None = None) -> DataFrame:
        """(id, hits, score, rank): search.bm25's result, from the postings of the query's terms alone.

        scope (id) keeps hits before the limit; corpus sums span all documents. mode: and, or, or auto,
        which falls back from and to or only if no kept document has all terms.
        """
        terms = query_terms(query)
        empty = self.spark.createDataFrame([], "id bigint, hits int, score double, rank int")
        if not terms:
            return empty
        seen = {r.term: r.docs for r in self._of_terms("terms", terms).groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
        if not seen or mode == "and" and len(seen) < len(terms):
            return empty
        n, total = self.sums()
        average = total / n if total else 1.0
        idf = F.create_map(*(x for t, d in seen.items() for x in (F.lit(t), F.lit(math.log(1 + (n - d + 0.5) / (d + 0.5))))))
        tf = F.col("tf").cast("double")
        part = idf[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
        rows = self._of_terms("postings", list(seen))
        found = rows.groupBy("id").agg(F.count("*").cast("int").alias("hits"), F.sum(part).alias("score"))
        if scope is not None:
            found = found.join(scope.select("id").distinct(), "id", "left_semi")
        every = found.where(F.col("hits") == len(terms))
        if mode == "and" or mode == "auto" and len(seen) == len(terms) and not every.isEmpty():
            found = every
        order = (F.desc(F.round("score", 10)), F.asc("id"))
        return found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


_built: dict[tuple[Hashable, ...], PostingsIndex] = {}


def index_of(docs: DataFrame, ident: str, text: Column, name: str) -> PostingsIndex:
    """The session's index called name, built where it isn't yet, in the folder that executors share."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _built:
        _built[key] = PostingsIndex.build(docs, ident, text, f"{shared_folder(spark)}/postings-{spark.sparkContext.applicationId}-{len(_built)}")
    return _built[key]
