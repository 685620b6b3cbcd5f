"""A data source of its own: folders of Arrow segments with a log of commits, read and written in batches and as streams.

``data/`` holds segments, each written by one task; ``log/`` has one entry a commit with the segments it adds, their rows and
the least and largest value of each column. A segment without an entry doesn't exist for readers, so what a failed job
leaves is never read. Readers plan a partition a segment, without those that a pushed filter rules out, and a stream's
offset is the number of entries. A table has one writer at a time, as entries are numbered by their count.

The classes are made within a function, so they travel to the workers by value.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, datasource as D, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "segments"
#: A column of ones. Spark plans a source's partitions once for each set of pushed filters and keeps the last plan, also for a later
#: query of the same DataFrame that pushes none; a condition on this column, which is pushed always, keeps such plans apart.
THERE = "_there"
#: Lets Spark hand filters to sources written in Python.
PUSH = "spark.sql.python.filterPushdown.enabled"


def source() -> type[D.DataSource]:
    """The data source's class. Options: ``path``, a folder that driver and executors share."""

    def opened(path: str) -> tuple[fs.FileSystem, str]:
        # Hadoop writes file:/x where others write file:///x
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)

    def entries(path: str, start: int = 0, end: int | None = None) -> list[dict]:
        """Log entries from ``start`` on, in order."""
        system, root = opened(path)
        found = system.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
        names = sorted(f.path for f in found if f.path.endswith(".json"))
        return [json.loads(system.open_input_file(p).read()) for p in names[start:end]]

    def live(path: str) -> list[dict]:
        """Segments of the table as it is: an entry that replaces drops all before it."""
        segments: list[dict] = []
        for e in entries(path):
            segments = ([] if e["replaces"] else segments) + e["segments"]
        return segments

    def plain(value):
        """A value as the log has it: numbers and texts, times as microseconds; None where it has no use for pruning."""
        if hasattr(value, "isoformat"):
            return value.isoformat()
        return value if isinstance(value, (int, float, str)) and value == value else None

    def bounds(columns: Sequence[pa.Array], names: Sequence[str]) -> dict[str, list]:
        out = {}
        for name, c in zip(names, columns):
            if pa.types.is_integer(c.type) or pa.types.is_floating(c.type) or pa.types.is_string(c.type) or pa.types.is_temporal(c.type):
                least = pc.min_max(c).as_py()
                pair = [plain(least["min"]), plain(least["max"])]
                if pair[0] is not None:
                    out[name] = pair
        return out

    class Segment(D.InputPartition):
        def __init__(self, path: str):
            self.path = path

    def rows_of(root: str, columns: list[str], segment: Segment) -> Iterator[pa.RecordBatch]:
        system, folder = opened(root)
        with pa.ipc.open_file(system.open_input_file(f"{folder}/data/{segment.path}")) as file:
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                there = {**dict(zip(batch.schema.names, batch.columns)), THERE: pa.array([1] * batch.num_rows, pa.int8())}
                yield pa.RecordBatch.from_arrays([there[c] for c in columns], columns)

    class Written(D.WriterCommitMessage):
        def __init__(self, segments: list[dict]):
            self.segments = segments

    def write_segment(root: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Written:
        """One task's rows as one segment, if there are any."""
        system, folder = opened(root)
        system.create_dir(f"{folder}/data", recursive=True)
        name, rows, limits = f"{uuid.uuid4().hex}.arrow", 0, {}
        try:
            with system.open_output_stream(f"{folder}/data/{name}") as out, pa.ipc.new_file(out, schema) as writer:
                for batch in batches:
                    batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
                    if batch.num_rows:
                        writer.write_batch(batch)
                        rows += batch.num_rows
                        for c, (lo, hi) in bounds(batch.columns, schema.names).items():
                            limits[c] = [min(lo, limits.get(c, [lo])[0]), max(hi, limits.get(c, [hi, hi])[1])]
        except BaseException:
            system.delete_file(f"{folder}/data/{name}")
            raise
        if not rows:
            system.delete_file(f"{folder}/data/{name}")
        return Written([{"path": name, "rows": rows, "bounds": limits}] if rows else [])

    def publish(root: str, schema: T.StructType, messages, replaces: bool, entry: str) -> None:
        """The second phase: one entry, which appears as a whole."""
        system, folder = opened(root)
        system.create_dir(f"{folder}/log", recursive=True)
        body = {"schema": schema.jsonValue(), "replaces": replaces, "segments": [s for m in messages if m for s in m.segments]}
        hidden = f"{folder}/log/.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps(body).encode())
        system.move(hidden, f"{folder}/log/{entry}.json")

    def withdraw(root: str, messages) -> None:
        system, folder = opened(root)
        for m in messages:
            for s in m.segments if m else ():
                system.delete_file(f"{folder}/data/{s['path']}")

    class Reader(D.DataSourceReader):
        def __init__(self, root: str, schema: T.StructType):
            self.root, self.columns, self.asked = root, schema.names, []

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)) and len(f.attribute) == 1:
                    self.asked.append((type(f).__name__, f.attribute[0], plain(f.value)))
                yield f  # rows are still filtered by Spark: segments are skipped as a whole only

        def _may_hold(self, limits: dict[str, list]) -> bool:
            for kind, name, value in self.asked:
                if name in limits and value is not None and isinstance(value, str) == isinstance(limits[name][0], str):
                    lo, hi = limits[name]
                    if not {"EqualTo": lo <= value <= hi, "GreaterThan": hi > value, "GreaterThanOrEqual": hi >= value, "LessThan": lo < value, "LessThanOrEqual": lo <= value}[kind]:
                        return False
            return True

        def partitions(self):
            return [Segment(s["path"]) for s in live(self.root) if self._may_hold(s["bounds"])]

        def read(self, partition):
            # Spark asks for a partition where there is none
            if partition is not None:
                yield from rows_of(self.root, self.columns, partition)

    class StreamReader(D.DataSourceStreamReader):
        def __init__(self, root: str, schema: T.StructType):
            self.root, self.columns = root, schema.names

        def initialOffset(self):
            return {"entries": 0}

        def latestOffset(self):
            return {"entries": len(entries(self.root))}

        def partitions(self, start, end):
            new = entries(self.root, start["entries"], end["entries"])
            return [Segment(s["path"]) for e in new for s in e["segments"]]

        def read(self, partition):
            yield from rows_of(self.root, self.columns, partition)

        def commit(self, end):
            pass

    class Writer(D.DataSourceArrowWriter):
        def __init__(self, root: str, schema: T.StructType, replaces: bool):
            self.root, self.schema, self.replaces = root, schema, replaces

        def write(self, iterator):
            return write_segment(self.root, to_arrow_schema(self.schema), iterator)

        def commit(self, messages):
            publish(self.root, self.schema, messages, self.replaces, f"{len(entries(self.root)):012d}")

        def abort(self, messages):
            withdraw(self.root, messages)

    class StreamWriter(D.DataSourceStreamArrowWriter):
        def __init__(self, root: str, schema: T.StructType):
            self.root, self.schema = root, schema

        def write(self, iterator):
            return write_segment(self.root, to_arrow_schema(self.schema), iterator)

        def commit(self, messages, batchId):
            # a batch that is run again after it was committed counts once
            system, folder = opened(self.root)
            found = system.get_file_info(fs.FileSelector(f"{folder}/log", allow_not_found=True))
            if any(f.path.endswith(f"-batch-{batchId}.json") for f in found):
                withdraw(self.root, messages)
            else:
                publish(self.root, self.schema, messages, False, f"{len(entries(self.root)):012d}-batch-{batchId}")

        def abort(self, messages, batchId):
            withdraw(self.root, messages)

    class Segments(D.DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            known = entries(self.options["path"])
            if not known:
                raise ValueError(f"no table at {self.options['path']}")
            return T.StructType([*T.StructType.fromJson(known[-1]["schema"]).fields, T.StructField(THERE, T.ByteType())])

        def reader(self, schema):
            return Reader(self.options["path"], schema)

        def streamReader(self, schema):
            return StreamReader(self.options["path"], schema)

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], schema, overwrite)

        def streamWriter(self, schema, overwrite):
            return StreamWriter(self.options["path"], schema)

    return Segments


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(source())
    spark.conf.set(PUSH, "true")


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add ``df`` to the table at ``path`` as one commit, or replace it (``overwrite``); readers see all of it or nothing."""
    register(df.sparkSession)
    df.write.format(NAME).option("path", path).mode(mode).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).load().where(F.col(THERE) == 1).drop(THERE)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a table as they come; entries that replace are read as additions."""
    register(spark)
    return spark.readStream.format(NAME).option("path", path).load().drop(THERE)
