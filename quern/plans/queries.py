"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import formats, functions, relational, scale, streams  # noqa: F401  (their queries register themselves)
from quern.plans.registry import PLANS, Plan, Tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(plan: Plan):
        return lambda spark, folder: plan(Tables(spark, folder))

    return {name: bound(plan) for name, (plan, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
