"""Semi-structured values: JSON parsed once to the variant type, read by typed paths, its shape found by an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def parsed(df: DataFrame, json: str, name: str) -> DataFrame:
    """``df`` with the JSON text of a column as a variant; null where that is null or no JSON."""
    return df.withColumn(name, F.try_parse_json(json))


def shredded(df: DataFrame, value: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a typed column for each name: (path, type). A path that is missing or of another type gives null."""
    return df.withColumns({name: F.try_variant_get(value, path, kind) for name, (path, kind) in paths.items()})


def fields(df: DataFrame, value: str, keep: Sequence[str]) -> DataFrame:
    """(keep, pos, key, value variant): a row for each field of the objects in a variant column."""
    view = df.select(*keep, F.col(value).alias("_value"))
    return view.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_value").outer())).select(*keep, "pos", "key", "value")


def schema_by(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, shape): the schema that all variants of a group have in common, merged over the rows by a two-step aggregate."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(value).alias("shape"))
