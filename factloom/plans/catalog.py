"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import columns, jobs, pool_jobs, scores, stores  # noqa: F401  (they register their queries)
from factloom.plans.registry import REGISTRY, Tables


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Build a registered query on the tables of a folder."""
    return REGISTRY[name].run(Tables(spark, folder))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, name=name: run(name, spark, folder)) for name in REGISTRY}


def oracles() -> dict[str, str]:
    return {name: q.oracle for name, q in REGISTRY.items() if q.oracle}
