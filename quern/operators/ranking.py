"""Top-k with full tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in an order: each task keeps k, so no full sort takes place."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered. Tasks cut their groups to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
