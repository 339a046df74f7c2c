"""Registry of the library's queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict = {}
_SQL: dict = {}
_MODULES = ("q_metrics", "q_ensemble", "q_manifest", "q_grid", "q_interval", "q_sentence", "q_layers", "q_pairwise", "q_store", "q_stream")


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) under name, with the SQL that must give the same rows."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"gridwise.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
