"""Scatter / map / flat_map / group_by / gather as lazy DataFrame plans. One row is one partition of work."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession


class Scatter:
    """Rows to be worked on. Nothing runs until a result is read, and a chain of maps stays one stage."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def of(cls, spark: SparkSession, items: Iterable, schema: str) -> Scatter:
        return cls(spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in items], schema))

    @classmethod
    def empty(cls, spark: SparkSession, schema: str) -> Scatter:
        return cls(spark.createDataFrame([], schema))

    def map(self, **columns: Column) -> Scatter:
        """One row for each row: the named columns."""
        return Scatter(self.rows.select(*[c.alias(n) for n, c in columns.items()]))

    def flat_map(self, f: Callable[[DataFrame], DataFrame]) -> Scatter:
        """Any number of rows for each row, such as an explode; rows of empty results vanish."""
        return Scatter(f(self.rows))

    def group_by(self, *keys: str | Column, **aggregates: Column) -> Scatter:
        """One row for each key. The order of groups is undefined."""
        return Scatter(self.rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]))

    def gather(self, **aggregates: Column) -> DataFrame:
        """All rows to one."""
        return self.rows.agg(*[c.alias(n) for n, c in aggregates.items()])
