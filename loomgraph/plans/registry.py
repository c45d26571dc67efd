"""How the query modules name their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import materialise
from .bindings import oracle, view


class Tables:
    """The derived views and tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.written = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.written)

    def write(self, *names: str) -> Tables:
        """Writes views once that a query reads more than once; what is made of them reads the tables."""
        for name in names:
            self.written[name] = materialise(getattr(self, name), name)
        return self


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a function of Tables under a name, with the SQL that says the same."""

        def register(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = oracle(sql)
            return f

        return register
