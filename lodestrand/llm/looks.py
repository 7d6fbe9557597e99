"""Problem 10: texts that look alike, found by one consistent form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.pairs import salted_pairs
from lodestrand.llm.uniform import uniform
from lodestrand.session import cut, table


def uniform_texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, form, changed): every text in its one form.

    Null texts give a null form and changed false; further columns of df are ignored; repeated rows
    come out as often as they go in. Whole texts, one pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            forms = [uniform(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array([f != t for f, t in zip(forms, texts)], pa.bool_())], names=["id", "form", "changed"])

    src = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id bigint, form string, changed boolean")


def form_keys(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, form_key, text_key): 128-bit digests of form and text, so that no text is shuffled.

    Rows with a null id or text are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(uniform(t)) for t in texts], pa.binary()), pa.array([digest(t) for t in texts], pa.binary())], names=["id", "form_key", "text_key"])

    src = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    return src.mapInArrow(run, "id bigint, form_key binary, text_key binary")


def same_look_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(a, b), a < b: rows whose texts differ in characters but share one form.

    Forms with a single spelling drop out before any pairing, so exact copies cost nothing; hot
    forms are salted. Empty input gives no rows.
    """
    keys = cut(form_keys(df, ident, text))
    pairs = salted_pairs(keys, "form_key", "id", ["text_key"], "text_key_a <> text_key_b", differing="text_key")
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def look_classes(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, class_id): one row per row whose form several spellings share, with its class's smallest id."""
    keys = cut(form_keys(df, ident, text))
    firsts = keys.groupBy("form_key").agg(F.min("id").alias("class_id"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi")
    return keys.join(firsts.select("form_key", "class_id"), "form_key").select("id", "class_id")


def p10_found(spark, d):
    return same_look_pairs(table(spark, d, "documents"), "doc_id", "text").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p10_classes(spark, d):
    return look_classes(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_uniform(spark, d):
    return uniform_texts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_classes": p10_classes, "p10_uniform": p10_uniform}
SQL: dict[str, str] = {}
