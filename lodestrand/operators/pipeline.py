"""A candidate pipeline of DataFrame stages: sources, hydrators, filters, scorers, selector, side effects.

Stages build one plan; nothing runs until the caller acts on the result. A stage that fails while it
is built is left out and reported, an optional stage is gated by enable().
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.fusion import first_per_key, top_k


class Source(Protocol):
    name: str

    def candidates(self) -> DataFrame: ...


class Hydrator(Protocol):
    name: str

    def hydrate(self, candidates: DataFrame) -> DataFrame: ...


class Filter(Protocol):
    name: str

    def keep(self, candidates: DataFrame) -> tuple[DataFrame, DataFrame | None]: ...


class Scorer(Protocol):
    name: str

    def score(self, candidates: DataFrame) -> DataFrame: ...


class Selector(Protocol):
    name: str

    def select(self, candidates: DataFrame) -> DataFrame: ...


@dataclass
class FixedSource:
    name: str
    frame: DataFrame

    def candidates(self) -> DataFrame:
        return self.frame


@dataclass
class JoinHydrator:
    """Adds columns by key; a candidate without a match keeps nulls. more must hold a key once."""

    name: str
    more: DataFrame
    key: str

    def hydrate(self, candidates: DataFrame) -> DataFrame:
        return candidates.join(self.more, self.key, "left")


@dataclass
class CachedHydrator:
    """Takes hits from a cache and computes misses only."""

    name: str
    cache: DataFrame
    key: str
    compute: Callable[[DataFrame], DataFrame]

    def hydrate(self, candidates: DataFrame) -> DataFrame:
        hits = candidates.join(self.cache, self.key)
        misses = self.compute(candidates.join(self.cache, self.key, "left_anti"))
        return hits.unionByName(misses)


@dataclass
class DedupFilter:
    key: str
    best: str
    name: str = "dedup"

    def keep(self, candidates: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The best candidate of each key; ties by source."""
        return first_per_key(candidates, [self.key], [F.desc(self.best), "source_ord"]), None


@dataclass
class WhereFilter:
    name: str
    condition: Column

    def keep(self, candidates: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        held = F.coalesce(self.condition, F.lit(False))
        return candidates.where(held), candidates.where(~held)


@dataclass
class ScoreColumn:
    column: str
    value: Column
    name: str = "score"

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn(self.column, self.value)


@dataclass
class TopKSelector:
    column: str
    order: str
    k: float
    name: str = "top-k"

    def select(self, candidates: DataFrame) -> DataFrame:
        return top_k(candidates, self.column, self.order, self.k)


class PassthroughSelector:
    name = "passthrough"

    def select(self, candidates: DataFrame) -> DataFrame:
        return candidates


class MemoryTelemetry:
    """Keeps stage events; combine several with CompositeTelemetry."""

    def __init__(self):
        self.events: list[dict] = []

    def emit(self, event: dict) -> None:
        self.events.append(event)


@dataclass
class CompositeTelemetry:
    sinks: list

    def emit(self, event: dict) -> None:
        for sink in self.sinks:
            sink.emit(event)


@dataclass
class Result:
    selected: DataFrame
    removed: list[tuple[str, DataFrame]]
    failed: list[tuple[str, str]]


@dataclass
class CandidatePipeline:
    sources: list = field(default_factory=list)
    hydrators: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    scorers: list = field(default_factory=list)
    selector: Selector = field(default_factory=PassthroughSelector)
    effects: list[Callable[[DataFrame], None]] = field(default_factory=list)
    telemetry: object = field(default_factory=MemoryTelemetry)

    def execute(self) -> Result:
        failed: list[tuple[str, str]] = []
        removed: list[tuple[str, DataFrame]] = []
        frames = []
        for n, source in enumerate(self._enabled(self.sources)):
            got = self._stage("source", source, source.candidates, failed)
            if got is not None:
                frames.append(got.withColumn("source_ord", F.lit(n)))
        if not frames:
            raise ValueError(f"no source could be read: {failed}")
        now = frames[0]
        for frame in frames[1:]:
            now = now.unionByName(frame, allowMissingColumns=True)
        for hydrator in self._enabled(self.hydrators):
            now = self._stage("hydrator", hydrator, lambda h=hydrator, c=now: h.hydrate(c), failed, now)
        for rule in self._enabled(self.filters):
            kept = self._stage("filter", rule, lambda f=rule, c=now: f.keep(c), failed, (now, None))
            now = kept[0]
            if kept[1] is not None:
                removed.append((rule.name, kept[1]))
        for scorer in self._enabled(self.scorers):
            now = self._stage("scorer", scorer, lambda s=scorer, c=now: s.score(c), failed, now)
        chosen = self._stage("selector", self.selector, lambda: self.selector.select(now), failed, now)
        for effect in self.effects:
            self._stage("effect", effect, lambda e=effect: e(chosen), failed)
        return Result(chosen, removed, failed)

    @staticmethod
    def _enabled(stages: list) -> list:
        return [s for s in stages if getattr(s, "enable", lambda: True)()]

    def _stage(self, kind: str, stage, build: Callable, failed: list, otherwise=None):
        name, began = getattr(stage, "name", getattr(stage, "__name__", kind)), time.perf_counter()
        try:
            out = build()
            if isinstance(out, DataFrame):
                out.schema  # analysis errors belong to the stage
            return out
        except Exception as error:  # one bad stage must not take the others down
            failed.append((name, f"{type(error).__name__}: {error}"))
            return otherwise
        finally:
            self.telemetry.emit({"kind": kind, "stage": name, "seconds": time.perf_counter() - began})
