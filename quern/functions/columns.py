"""Column expressions used by several plans; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return F.col(price) * (1 - F.col(discount))


def seconds(time: str) -> Column:
    """Whole seconds since 1970 of a time stamp without zone, read as UTC."""
    return F.unix_timestamp(F.col(time).cast("timestamp"))


def nearest_second(time: str) -> Column:
    """The same rounded, halves to the even second, as DuckDB's ``epoch(time)::BIGINT`` gives it."""
    return F.rint(F.unix_micros(F.col(time).cast("timestamp")) / 1e6).cast("long")


def json_text(column: str, field: str) -> Column:
    return F.get_json_object(column, f"$.{field}")
