"""Names of queries, what makes them, and their SQL."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (on a cluster it comes with --py-files)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports every module of queries."""
    import importlib
    import pkgutil

    import lodestrata.plans as here

    for m in pkgutil.iter_modules(here.__path__):
        if m.name != "registry":
            importlib.import_module(f"lodestrata.plans.{m.name}")
