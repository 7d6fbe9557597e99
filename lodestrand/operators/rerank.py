"""Reranking of few candidates by a pair model, in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 16  # pairs that the model scores in one call


class RerankerService(Protocol):
    """Logits of (query, text) pairs, one each."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def sigmoid(x: float) -> float:
    """1 / (1 + e^-x) without overflow; 0 for what is no number."""
    if math.isnan(x):
        return 0.0
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def reranked(hits: DataFrame, query: str, text: str, model: RerankerService, limit: int, batch: int = BATCH) -> DataFrame:
    """hits (with rank and text) with relevance in place of text, by relevance and then rank, the first limit.

    The whole text of each hit is scored; null counts as empty. Pairs of a batch whose call fails get no
    relevance and stand behind the others in the order they had.
    """
    kept = [c for c in hits.columns if c != text]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in hits.dtypes if c != text) + ", relevance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            scores: list[float | None] = []
            for at in range(0, len(texts), batch):
                pairs = [(query, t or "") for t in texts[at : at + batch]]
                try:
                    scores += [sigmoid(float(x)) for x in model(pairs)]
                except Exception:  # the order of the hits remains
                    scores += [None] * len(pairs)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "relevance"])

    order = (F.desc_nulls_last("relevance"), F.asc("rank"))
    top = hits.mapInArrow(run, schema).orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def cut_by(threshold: float) -> Callable[[DataFrame], DataFrame]:
    """A filter that drops hits of less relevance; those without one stay."""
    return lambda df: df.where(F.col("relevance").isNull() | (F.col("relevance") >= threshold))
