"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.sources.shared import checkpoint_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    spark = df.sparkSession
    stored = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if stored.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(stored.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt_anew(counted: DataFrame, *keys: str) -> DataFrame:
    """An aggregate's rows, one a key, dealt by another hash than the join on ``keys`` that follows.

    So they reach the join through a shuffle of its own. Adaptive execution only splits hot keys of
    a join whose sides both do; straight from the aggregate, all rows of a hot key would meet in one task.
    """
    return counted.repartition(F.xxhash64(*keys))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, through the driver's file server."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quern-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


#: What this worker process keeps for its next task: one value, the last operator's.
_KEPT: dict[object, object] = {}


def kept(key, make: Callable[[], object]):
    """``make()`` once per worker process, until another operator keeps something there."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give memory that a task has freed back to the system, as workers wait for their next task with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_partitions(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package's code at hand on the executors."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def map_batches(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], Iterable]], schema: str) -> DataFrame:
    """``map_partitions`` where ``work()`` runs once a task and returns the function of a batch.

    The function of a batch yields record batches (or tuples of columns in schema order). Spark
    bounds a batch by rows and bytes, so memory follows the batch and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            yield from each(batch)

    return map_partitions(df, run, schema)


#: Bits of a membership table. Its rows, 64 bits each, are half a million at most, whatever the number of keys.
MEMBER_BITS = 1 << 25


def members(keys: DataFrame, column: str) -> DataFrame:
    """A table of fixed size that tells keys that are certainly not in ``keys`` (long) from those that may be.

    The lowest bits of a key pick one bit. Consecutive ids collide only beyond
    ``MEMBER_BITS``, hashes at random. Filled beyond that it lets everything pass, which costs
    time and never a row.
    """
    place = F.col(column).bitwiseAND(F.lit(MEMBER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return checkpointed(keys.where(F.col(column).isNotNull()).groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))


def maybe_members(df: DataFrame, column: str, known: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows that may be in the table ``known`` (left_semi), or the others (left_anti), by a bounded broadcast."""
    place = F.col(column).bitwiseAND(F.lit(MEMBER_BITS - 1))
    bit = F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")))
    return df.join(F.broadcast(known), (F.shiftright(place, 6) == F.col("_word")) & (bit != 0), how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
