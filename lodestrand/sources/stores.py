"""Vector stores and embedding sources behind small interfaces."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import vectors
from lodestrand.operators.merge import upserted
from lodestrand.sources.remote import DIALECTS, HttpVectorStore
from lodestrand.sources.versions import VersionedTable

VECTORS = "vid string, embedding array<float>, namespace string, project_name string, type string, ref_id string"


class EmbeddingService(Protocol):
    """Vectors of texts, one each."""

    def __call__(self, texts: list[str]) -> list: ...


class AnalysisService(Protocol):
    """A model's answer about a file's text, which config.analysis reads."""

    def __call__(self, text: str) -> str: ...


class VectorStore(Protocol):
    def search(self, vector: list[float], k: int, where: dict[str, str] | None = None) -> DataFrame: ...

    def upsert(self, rows: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...


class ParquetVectorStore:
    """A versioned table of vectors by vid: a write makes anew only the buckets of the vids it brings, and readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.held = spark, VersionedTable(spark, path, VECTORS, ["vid"])

    def read(self) -> DataFrame:
        return self.held.read()

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with the same vid; all vectors have one dimension, the table's."""
        fresh = rows.dropDuplicates(["vid"])
        known = [r[0] for r in self.read().select(F.size("embedding")).limit(1).collect()]
        least, most = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        sizes = {x for x in (*known, least, most) if x is not None}
        if len(sizes) > 1:
            raise ValueError(f"vectors of several dimensions: {sorted(sizes)}")
        self.held.rewrite(lambda old: upserted(old, fresh.select(*old.columns), ["vid"]), self.held.touched_by(fresh))

    def delete(self, ids: DataFrame) -> None:
        self.held.rewrite(lambda old: old.join(ids.select("vid"), "vid", "left_anti").select(*old.columns), self.held.touched_by(ids))

    def delete_namespace(self, namespace: str) -> None:
        self.held.rewrite(lambda old: old.where(~F.col("namespace").eqNullSafe(namespace)))

    def purge(self, project: str) -> None:
        """Drop a project's vectors."""
        self.held.rewrite(lambda old: old.where(~F.col("project_name").eqNullSafe(project)))

    def split(self, project: str, to: ParquetVectorStore) -> int:
        """Move a project's vectors to a store of its own; they leave this one once the copy has them all. How many."""
        own = self.read().where(F.col("project_name") == project)
        n = own.count()
        to.upsert(own)
        arrived = to.read().where(F.col("project_name") == project).join(own.select("vid"), "vid", "left_semi").count()
        if arrived != n:
            raise RuntimeError(f"{arrived} of {n} vectors arrived")
        self.purge(project)
        return n

    def ids(self) -> DataFrame:
        return self.read().select("vid")

    def search(self, vector: list[float], k: int, where: dict[str, str] | None = None) -> DataFrame:
        """(vid, type, ref_id, score) of the k nearest by L2 that match the equality filters; score is 1 / (1 + distance)."""
        rows = self.read()
        for column, wanted in (where or {}).items():
            rows = rows.where(F.col(column) == wanted)
        asked = F.array(*(F.lit(float(x)) for x in vector))
        near = rows.select("vid", "type", "ref_id", vectors.l2(F.col("embedding"), asked).alias("d")).orderBy("d", "vid").limit(k)
        return near.select("vid", "type", "ref_id", vectors.distance_score(F.col("d")).alias("score"))


class NullVectorStore:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def search(self, vector: list[float], k: int, where: dict[str, str] | None = None) -> DataFrame:
        return self.spark.createDataFrame([], "vid string, type string, ref_id string, score double")

    def upsert(self, rows: DataFrame) -> None:
        """Nothing is kept."""

    def delete(self, ids: DataFrame) -> None:
        """Nothing was kept."""


@dataclass
class RoutingVectorStore:
    """Sends each call to the store a route names, else to the central one."""

    central: VectorStore
    own: dict[str, VectorStore]

    def route(self, namespace: str | None) -> VectorStore:
        return self.own.get(namespace or "", self.central)


MAKERS: dict[str, Callable[..., VectorStore]] = {"parquet": lambda spark, **c: ParquetVectorStore(spark, c["path"]), "null": lambda spark, **c: NullVectorStore(spark)}
for _service in DIALECTS:
    MAKERS[_service] = functools.partial(HttpVectorStore, service=_service)


def vector_store(spark: SparkSession, kind: str, **config) -> VectorStore:
    """A store by kind. Remote kinds register a maker in MAKERS; without one they are refused."""
    if kind not in MAKERS:
        raise ValueError(f"no vector store of kind {kind}")
    return MAKERS[kind](spark, **config)


def hash_embedding(text: str, dim: int = 64) -> np.ndarray:
    """A deterministic unit vector from hashed words, for use without a model."""
    out = np.zeros(dim, np.float32)
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    length = float(np.linalg.norm(out))
    return out / length if length else out


# What some models want before stored texts and before queries; texts embedded in one call; tries of a call.
PASSAGE, QUERY, BATCH, TRIES = "passage: ", "query: ", 32, 3


def in_batches(texts: list[str], model: Callable[[list[str]], list], size: int = BATCH, tries: int = TRIES) -> list:
    """A model's vectors for texts, size at a time. A call that fails is tried again, then halved; a single text that still fails raises."""
    out: list = []
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        for left in reversed(range(tries)):
            try:
                out += model(part)
                break
            except Exception:
                if left:
                    continue
                if len(part) == 1:
                    raise
                out += in_batches(part, model, -(-len(part) // 2), tries)
    return out


def embedded(df: DataFrame, text: str, dim: int = 64, model: Callable[[list[str]], list] | None = None, prefix: str = "") -> DataFrame:
    """df with embedding, by Arrow batches; model embeds a list of texts, each after prefix, and lives in the worker."""
    make = model or (lambda part: [hash_embedding(t, dim) for t in part])

    @F.pandas_udf("array<float>")
    def embed(batch: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float32).tolist() for v in in_batches([prefix + (t or "") for t in batch], make)], index=batch.index, dtype=object)

    return df.withColumn("embedding", embed(F.col(text)))


def backfill(df: DataFrame, text: str, state: str, dim: int = 64) -> DataFrame:
    """Embeds only rows whose embedding_hash differs from state: an anti-join on hashes before any model runs."""
    stale = df.where(~F.col("embedding_hash").eqNullSafe(F.col(state)))
    return embedded(stale, text, dim)
