"""The registry of queries: a plan, a function of the tables, under its own name with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import load


class Tables:
    """The tables of a folder: called with a name it gives a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)


Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, tuple[Plan, str | None]] = {}


def query(sql: str | None):
    """Registers a plan with its SQL; None where SQL can't express it."""

    def add(f: Plan) -> Plan:
        PLANS[f.__name__] = (f, sql)
        return f

    return add
