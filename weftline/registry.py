"""The register of queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_REGISTER: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        _REGISTER[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {name: f for name, (f, _) in _REGISTER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTER.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
