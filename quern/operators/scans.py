"""Windows over a whole table, or over keys that hold much of it, as a distributed prefix scan.

Spark puts all rows of a window's key into one task, and a window without a key into a single one. Here rows are
dealt by ranges of key and order, each range is summed up in a few numbers, and these are handed on from range
to range; every range then continues from what those before it hold.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.sources.shared import checkpoint_folder


def running(
    df: DataFrame, order: Sequence[str], sums: dict[str, str] | None = None, row_number: str | None = None,
    lags: dict[str, tuple[str, int]] | None = None, by: Sequence[str] = (), ranges: int | None = None,
) -> DataFrame:
    """``df`` with windows over its rows in ``order`` (ascending, null first), for each value of ``by`` or over all rows.

    ``sums`` has new columns that add up a column of whole numbers from the first row to the current one (null while there
    are only nulls), ``row_number`` names a count from 1, ``lags`` has new columns with the value of a column some rows before.
    Rows of equal ``order`` come in any order, so it should tell rows apart. Sums are longs.

    The rows are shuffled once, into ``ranges`` ranges (by default the session's shuffle partitions), and written in order
    to the checkpoint folder, as both passes must see the same ranges. What a range hands on is a count, a sum a
    column and as many values as the longest lag, and one such row a range is all that reaches the driver.
    """
    sums, lags, spark = sums or {}, lags or {}, df.sparkSession
    for c in sums.values():
        if not isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            raise ValueError(f"{c} is no column of whole numbers; sums of fractions depend on how rows are dealt")
    checkpoint_folder(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(c) for c in (*by, *order)]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    dealt = dealt.checkpoint()
    longest = max((k for _, k in lags.values()), default=0)
    lagged = sorted({c for c, _ in lags.values()})
    by = list(by)

    def column(batch: pa.RecordBatch, name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))

    def advance(batch: pa.RecordBatch, state: dict | None) -> tuple[dict, dict[str, pa.Array]]:
        """The state after a batch, and the new columns of its rows."""
        size = batch.num_rows
        values = [column(batch, c).to_numpy(zero_copy_only=False) for c in by]
        first, last = (tuple(column(batch, c)[i].as_py() for c in by) for i in (0, size - 1))
        fresh = np.zeros(size, bool)
        fresh[0] = state is None or state["key"] != first
        for c, v in zip(by, values):
            null = column(batch, c).is_null().to_numpy(zero_copy_only=False)
            fresh[1:] |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (v[1:] != v[:-1]))
        places = np.arange(size)
        began = np.maximum.accumulate(np.where(fresh, places, -1))  # -1: before this batch
        held = None if fresh[0] else state
        before = began < 0
        out: dict[str, pa.Array] = {}
        after = {"key": last, "first": first if state is None else state["first"], "single": (state is None or state["single"]) and not fresh[1:].any() and not (state is not None and fresh[0])}
        start = int(began[-1])
        count = np.where(before, places + 1 + (held["n"] if held else 0), places - began + 1)
        after["n"] = int(count[-1])
        if row_number:
            out[row_number] = pa.array(count, pa.int64())
        after["sums"] = {}
        for name, c in sums.items():
            own = column(batch, c)
            there = own.is_valid().to_numpy(zero_copy_only=False)
            filled = np.where(there, own.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            results = []
            for k, part in enumerate((filled, there.astype(np.int64))):
                total = np.cumsum(part)
                base = np.where(began > 0, total[np.maximum(began, 1) - 1], 0)
                results.append(total - base + np.where(before, held["sums"][name][k] if held else 0, 0))
            out[name] = pa.array(results[0], pa.int64(), mask=results[1] == 0)
            after["sums"][name] = tuple(int(r[-1]) for r in results)
        after["tails"] = {}
        for c in lagged:
            tail = held["tails"][c] if held else []
            own = column(batch, c)
            joined = pa.concat_arrays([pa.array(tail, own.type), own])
            for name, (source, k) in lags.items():
                if source == c:
                    at = places + len(tail) - k
                    seen = at >= np.where(before, 0, began + len(tail))
                    out[name] = joined.take(pa.array(np.where(seen, at, 0), mask=~seen))
            own_rows = joined[0 if start < 0 else start + len(tail) :]
            after["tails"][c] = own_rows[max(0, len(own_rows) - longest) :].to_pylist()
        return after, out

    def summary(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                place = column(batch, "_range")[0].as_py()
                state, _ = advance(batch, state)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], ["_range", "state"])

    needed = list(dict.fromkeys([*by, *sums.values(), *lagged, "_range"]))
    ends = {r["_range"]: pickle.loads(r["state"]) for r in dealt.select(*needed).mapInArrow(summary, "_range int, state binary").collect()}
    carried: dict[int, dict | None] = {}
    carry = None
    for place in sorted(ends):
        carried[place], end = carry, ends[place]
        if carry is not None and end["single"] and carry["key"] == end["key"]:
            added = {s: tuple(a + b for a, b in zip(carry["sums"][s], end["sums"][s])) for s in sums}
            tails = {c: (carry["tails"][c] + end["tails"][c])[-longest:] for c in lagged}
            end = {"key": end["key"], "first": end["first"], "single": False, "n": carry["n"] + end["n"], "sums": added, "tails": tails}
        carry = end
    sent = spark.sparkContext.broadcast(carried)

    new = [*([T.StructField(row_number, T.LongType())] if row_number else []), *(T.StructField(s, T.LongType()) for s in sums), *(T.StructField(s, df.schema[c].dataType) for s, (c, _) in lags.items())]
    schema = T.StructType([*df.schema.fields, *new])

    def finish(batches):
        state, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                state, begun = sent.value[column(batch, "_range")[0].as_py()], True
            state, out = advance(batch, state)
            columns = [*(column(batch, c) for c in df_columns), *(out[c] for c in new_columns)]
            yield pa.RecordBatch.from_arrays(columns, [*df_columns, *new_columns])

    df_columns, new_columns = df.columns, [f.name for f in new]
    return dealt.mapInArrow(finish, schema)
