"""Name -> (query, oracle SQL) for the signal operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.plans.views import Views, duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of ``Views`` under a name, with its DuckDB SQL where SQL can express it."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLES[name] = duckdb(oracle)
        return f

    return put


for _module in ("scalars", "lookups", "aggregates", "sequences", "recursions", "filters", "coding", "transport", "spatial"):
    importlib.import_module(f"framewright.plans.{_module}")
