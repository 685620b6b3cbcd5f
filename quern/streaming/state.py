"""Streams with state of their own, and joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) of each key after each batch that has rows of it; count and sum are the state.

    State is two numbers a key; the store keeps it from batch to batch. The function is a closure, so it
    travels to the workers by value.
    """
    kind = events.schema[key].dataType.simpleString()

    def add(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + len(rows), total + float(rows[value].sum())
        state.update((n, total))
        yield pd.DataFrame([(keys[0], n, total)], columns=[key, "n", "total"])

    return events.select(key, value).groupBy(key).applyInPandasWithState(add, f"{key} {kind}, n long, total double", "n long, total double", "append", "NoTimeout")


def joined_within(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, within: str) -> DataFrame:
    """Pairs of two streams of equal keys whose left time lies in the span ``within`` before the right time.

    Both sides have watermarks, so rows that can't find a partner any more leave the state.
    """
    near = (F.col(left_time) >= F.col(right_time) - F.expr(f"INTERVAL {within}")) & (F.col(left_time) < F.col(right_time))
    for c in by:
        near = near & (left[c] == right[c])
    return left.join(right, near)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last of the rows that a stream has written for each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in others))
