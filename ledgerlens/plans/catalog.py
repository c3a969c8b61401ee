"""The query catalogue: every registered query and its DuckDB SQL twin."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from . import q_core, q_graph, q_ml, q_monitor, q_stream


def _all() -> dict:
    return {**q_core.QUERIES, **q_graph.QUERIES, **q_monitor.QUERIES, **q_ml.QUERIES, **q_stream.QUERIES}


def _wrap(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _wrap(fn) for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
