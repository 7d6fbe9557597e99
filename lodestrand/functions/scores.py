"""Ranking scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the actions a reranker predicts.
ACTIONS = {"relevance": 1.0, "scope_match": 0.4, "freshness": 0.2, "code_proximity": 0.3, "authority": 0.3}


def rank_score(rank: Column) -> Column:
    return F.round(1 / (1 + F.log2(rank)), 3)


def reciprocal(rank: Column, k: int = 60) -> Column:
    return 1 / (F.lit(float(k)) + rank)


def recency(age: Column, half_life: float, floor: float = 0.0, ceiling: float = 1.0) -> Column:
    """2^(-age / half_life), negative ages as 0, within floor ... ceiling."""
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.pow(F.lit(2.0), -F.greatest(age.cast("double"), F.lit(0.0)) / half_life)))


def frequency(count: Column, saturation: int = 5, most: float = 1.0) -> Column:
    return F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) / saturation) * most


def weighted_sum(terms: list[tuple[Column, float]], offset: float = 1.0) -> Column:
    """Weighted values, non-finite as 0. Negative sums are squeezed below offset, others are raised by it; offset where nothing weighs."""
    weight = sum(abs(w) for _, w in terms)
    if weight == 0:
        return F.lit(offset)
    below = sum(-w for _, w in terms if w < 0)
    clean = [F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v) * w for v, w in terms]
    total = sum(clean[1:], clean[0])
    return F.when(total < 0, (total + below) / weight * offset).otherwise(total + offset)


def recent_file(rec: Column, matched: Column, edited: Column) -> Column:
    return rec * (0.4 + 0.6 * matched) + F.when(edited, 0.1).otherwise(0.0)


def action_score(actions: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum over a map of action to probability; absent actions count 0."""
    return sum((F.coalesce(F.element_at(actions, a), F.lit(0.0)) * w for a, w in (weights or ACTIONS).items()), F.lit(0.0))


def share_of_terms(words: Column, terms: list[str]) -> Column:
    """The share of terms among words; null words hold none, and without terms the share is 0."""
    if not terms:
        return F.lit(0.0)
    held = F.size(F.array_intersect(F.coalesce(words, F.array().cast("array<string>")), F.array(*map(F.lit, terms))))
    return held / F.lit(float(len(terms)))
