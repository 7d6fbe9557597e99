"""Queries register beside their SQL; names end in the inventory id they show."""

from __future__ import annotations

from collections.abc import Callable

from lodestrand.session import table


class Tables:
    """t.files, t.costs ...: the tables of one input folder."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(build: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return build

        return register
