"""Event-time operators on streams, and runs that read all there is and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's Parquet files as a stream; new files are read as they come."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # the file source watches folders; a single file is found by its name
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if spark.read.format("binaryFile").load(path).limit(2).count() == 1 else reader.parquet(path)


def with_event_time(events: DataFrame, time: str, late: str) -> DataFrame:
    """Time stamps without zone become UTC instants, as watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, width: str, *by: str) -> DataFrame:
    """Counts per window; state is dropped once the watermark has passed a window's end."""
    return events.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sliding(events: DataFrame, time: str, width: str, step: str, *by: str) -> DataFrame:
    return events.groupBy(F.window(time, width, step), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, *by: str) -> DataFrame:
    return events.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *by, "n")


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """One row per key within the watermark: exactly-once delivery made so by dropping repeats."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Run a stream over all present input into a Parquet folder, exactly once, and stop."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).start(path).awaitTermination()
