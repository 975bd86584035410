"""A registry of named queries, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Decorator: registers ``fn(read)`` under ``name``; ``read(table)`` gives a DataFrame."""

        def put(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return put

    def include(self, other: Registry) -> None:
        clash = self.queries.keys() & other.queries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        self.queries |= other.queries
        self.sql |= other.sql
