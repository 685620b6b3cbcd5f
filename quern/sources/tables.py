"""Reading and writing tables: Parquet, ORC, CSV and JSON folders, always with a known schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
#: Formats that carry their schema; the others need one, so that no pass is spent on inferring it.
SELF_DESCRIBING = ("parquet", "orc")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    if schema is None and kind not in SELF_DESCRIBING:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error", **options) -> None:
    """Write a folder. Rows of one partition value are first spread over tasks by adaptive rebalancing, so a hot value gives several files."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.format(kind).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def upsert(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of equal keys replaced by those of ``changes``, and the new ones added."""
    return old.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def save_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int, mode: str = "error") -> None:
    """A catalog table bucketed and sorted by keys: later joins and aggregates on them need no shuffle."""
    df.write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
