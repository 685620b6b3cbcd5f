"""User-defined functions: scalar, aggregate and table functions written in Python.

The functions that reach the executors are closures, so they travel by value and workers need
not have this package. Arrow carries the data; built-in expressions stay the better choice where
they exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def scalar(f: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """A function of pandas series, of one batch of rows at a time, as a function of columns."""

    def one(a: pd.Series) -> pd.Series:
        return f(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    def call(*columns: Column | str) -> Column:
        if len(columns) not in (1, 2):
            raise ValueError("one or two columns")
        return F.pandas_udf((one, two)[len(columns) - 1], kind)(*columns)

    return call


def aggregate(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], start: Callable[[pd.DataFrame], tuple], merge: Callable[[tuple, tuple], tuple], finish: Callable[[tuple], tuple], result: str
) -> DataFrame:
    """A user-defined aggregate in two steps, so that no group meets in one task as a whole.

    ``start`` reduces a batch's rows of a group (the given columns) to a state, a tuple of numbers;
    ``merge`` joins two states, ``finish`` turns the last into the columns of ``result`` (a schema).
    Each task merges its own states group by group and passes one row per group on, of the by
    columns and the state; only those are shuffled. States travel as doubles, so whole numbers beyond 2^53 lose digits.
    """
    keys, names = list(by), list(columns)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, tuple] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                state = start(rows[names])
                states[key] = merge(states[key], state) if key in states else state
            if len(states) > 100_000:
                yield pd.DataFrame([(*k, list(map(float, s))) for k, s in states.items()], columns=[*keys, "_state"])
                states.clear()
        yield pd.DataFrame([(*k, list(map(float, s))) for k, s in states.items()], columns=[*keys, "_state"])

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        states = [tuple(s) for s in rows["_state"]]
        state = states[0]
        for s in states[1:]:
            state = merge(state, s)
        return pd.DataFrame([(*(rows[k].iloc[0] for k in keys), *finish(state))], columns=[*keys, *out])

    out = [f.name for f in T.StructType.fromDDL(result).fields]
    states = df.select(*keys, *names).mapInPandas(partial, f"{fields}, _state array<double>")
    return states.groupBy(*keys).applyInPandas(final, f"{fields}, {result}")


def table_function(f: Callable[..., Iterable[tuple]], schema: str):
    """A function that gives any number of rows for its arguments, as a table function for lateral joins."""

    class Rows:
        def eval(self, *arguments):
            yield from f(*arguments)

    return F.udtf(Rows, returnType=schema)


def steps_of(column: str, name: str = "step"):
    """A table function over any table with a whole-number ``column``: its rows, and how far that moved since the row before.

    It takes a table argument; ``PARTITION BY`` deals the rows and ``ORDER BY`` sorts them within a partition. Its result's schema is
    found by analysis: the argument's, and a last column ``name``. One row of state a partition.
    """

    class Steps:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or column not in table.dataType.fieldNames():
                raise ValueError(f"a table with the column {column} is needed")
            return AnalyzeResult(schema=T.StructType([*table.dataType.fields, T.StructField(name, T.LongType())]))

        def __init__(self):
            self.last = None

        def eval(self, row):
            now = row[column]
            yield (*row, None if now is None or self.last is None else now - self.last)
            self.last = now if now is not None else self.last

    return F.udtf(Steps)
