"""Exact statistics of whole tables without holding or sorting them: order statistics and heavy hitters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.sources.shared import checkpoint_folder

#: Bins that a rank's range of values is cut into each round, and rounds after which narrowing is given up as faulty.
BINS, MAX_ROUNDS = 512, 200
#: Ranks that are looked for at once: groups times fractions times two.
MAX_RANKS = 20_000


def exact_percentiles(df: DataFrame, column: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, fraction, value): percentiles as percentile_cont gives them, for each value of ``by`` or of all rows.

    A percentile lies between two ranks. Each rank's range of values, at first from minimum to maximum, is cut into ``BINS``
    bins, the rows in them are counted, and the bin that holds the rank is the next range, until it is one value. A
    round is one aggregate whose state is ``BINS`` rows a rank, however many rows or distinct values there are, and every
    round at least the least and the largest value of a range part. Nulls and NaN are left out, as are groups without
    values. Groups are meant to be few and large; more than ``MAX_RANKS`` ranks are an error.
    """
    spark, by = df.sparkSession, list(by)
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    groups = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0")
    asked = groups.select(*by, "n", "lo", "hi", F.explode(F.array(*(F.lit(float(f)) for f in fractions))).alias("fraction"))
    place = F.col("fraction") * (F.col("n") - 1)
    ranks = asked.select(*by, "lo", "hi", F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).distinct()
    rows = ranks.limit(MAX_RANKS + 1).collect()
    if len(rows) > MAX_RANKS:
        raise ValueError(f"more than {MAX_RANKS} ranks")
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "_id int, _lo double, _hi double"])
    # rank: place within the range, range
    open_ = {i: (r["rank"], r["lo"], r["hi"]) for i, r in enumerate(rows)}
    found = {i: lo for i, (_, lo, hi) in open_.items() if lo == hi}
    for _ in range(MAX_ROUNDS):
        open_ = {i: x for i, x in open_.items() if i not in found}
        if not open_:
            break
        ranges = F.broadcast(spark.createDataFrame([(*(rows[i][c] for c in by), i, lo, hi) for i, (_, lo, hi) in open_.items()], kinds))
        within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        met = values.alias("a").join(ranges.alias("b"), reduce(Column.__and__, [*same, within]))
        # halves first, as the difference of two values may be infinite
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = met.groupBy("_id", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        counted: dict[int, list] = {}
        for r in bins.collect():
            counted.setdefault(r["_id"], []).append(r)
        for i, own in counted.items():
            rank = open_[i][0]
            for r in sorted(own, key=lambda r: r["_bin"]):
                if rank < r["n"]:
                    break
                rank -= r["n"]
            open_[i] = rank, r["lo"], r["hi"]
            if r["lo"] == r["hi"]:
                found[i] = r["lo"]
    else:
        raise RuntimeError("ranks were not found")
    known = F.broadcast(spark.createDataFrame([(*(r[c] for c in by), r["rank"], found[i]) for i, r in enumerate(rows)], kinds.replace("_id int, _lo double, _hi double", "rank long, value double")))
    asked = asked.withColumn("place", place)

    def at(rank: Column, name: str, left: DataFrame) -> DataFrame:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        joined = left.alias("a").join(known.alias("b"), reduce(Column.__and__, [*same, rank == F.col("b.rank")]))
        return joined.select("a.*", F.col("b.value").alias(name))

    both = at(F.ceil("a.place"), "upper", at(F.floor("a.place"), "lower", asked))
    part = F.col("place") - F.floor("place")
    return both.select(*by, "n", "fraction", (F.col("lower") + (F.col("upper") - F.col("lower")) * part).alias("value"))


def heavy_hitters(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, n): the keys with more than one row in ``k``, with their exact counts; fewer than ``k`` rows.

    Each task keeps a Misra-Gries summary: at most ``k`` counters, all lowered together when there are more. Summaries
    merge by adding, and a key above one in ``k`` is in one of them for certain. A second pass counts the
    candidates alone, so no aggregate by key over all rows is made. What a summary takes off is at most one in ``k + 1`` of its
    rows, and only keys that could reach the bound with all that was taken off are candidates, so at most ``k (k + 1)``
    keys are broadcast. Null is a key like any other.
    """
    keys = list(keys)
    kinds = [df.schema[c].dataType.simpleString() for c in keys]

    def summarise(batches):
        counters: Counter = Counter()
        rows = lowered = 0
        for batch in batches:
            rows += batch.num_rows
            counters.update(Counter(zip(*(c.to_pylist() for c in batch.columns))))
            if len(counters) > k:
                by = sorted(counters.values(), reverse=True)[k]
                lowered += by
                counters = Counter({x: n - by for x, n in counters.items() if n > by})
        found = [*counters.items()]
        columns = [pa.array([x[i] for x, _ in found] + [None], arrow[i]) for i in range(len(keys))]
        # the last row has no key of its own: rows of the task, and by how much its counters may be too low
        yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in found] + [None], pa.int64()), pa.array([None] * len(found) + [rows], pa.int64()), pa.array([None] * len(found) + [lowered], pa.int64())], names)

    arrow = [to_arrow_type(df.schema[c].dataType) for c in keys]
    names = [*keys, "_n", "_rows", "_low"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keys, kinds)), "_n long, _rows long, _low long"])
    summaries = df.select(*keys).mapInArrow(summarise, schema)
    checkpoint_folder(df.sparkSession)
    summaries = summaries.checkpoint()
    total, low = summaries.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_low"), F.lit(0))).first()
    possible = summaries.where("_n is not null").groupBy(*keys).agg(F.sum("_n").alias("_n")).where((F.col("_n") + F.lit(low)) * k > total).select(*keys)
    same = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys))
    met = df.select(*keys).alias("a").join(F.broadcast(possible.alias("b")), same, "left_semi")
    return met.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") * k > total)
