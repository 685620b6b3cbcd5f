"""Joins that Spark has no operator for, composed of equi-joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.operators.scans import running
from quern.operators.statistics import heavy_hitters


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], period: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key at or before its time; null where none is.

    Both sides are put together and walked once per key in time order, so the work is a sort
    of left plus right; a range join would make all pairs first. Right rows with equal times
    are ordered by their values, the largest winning.

    With ``period`` (a coarsening of time, such as its day) a key's rows are walked period by period,
    in as many tasks, and what a period starts with comes from the last right row of each earlier one: for
    keys that hold a large part of all rows.
    """
    names = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).alias("_right"))
    r = right.select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(*values).alias("_right"))
    both, parts = l.unionByName(r), list(by)
    if period:
        both, parts = both.withColumn("_period", period(F.col("_time"))), [*by, "_period"]
    so_far = Window.partitionBy(*parts).orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(so_far)).where("_side = 1")
    if period:
        before = Window.partitionBy(*by).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy(*parts).agg(F.max(F.when(F.col("_side") == 0, F.struct("_time", "_right"))).alias("_last"))
        ends = ends.withColumn("_earlier", F.last("_last", ignorenulls=True).over(before)).select(*parts, "_earlier")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in parts]
        found = found.alias("a").join(ends.alias("b"), reduce(Column.__and__, same), "left").select(*(F.col(f"a.{c}") for c in by), "_left", F.coalesce("_found", "_earlier._right").alias("_found"))
    return found.select(*by, "_left.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], time: str, start: str, stop: str, width: int) -> DataFrame:
    """Pairs of equal key with start <= time < stop, all numbers; without ``by`` pairs of any rows.

    Intervals are cut at multiples of ``width`` and joined on (key, slice), so each point
    meets only the intervals of its slice. ``width`` near the usual interval length is best.
    """
    cut = intervals.where(F.col(start) < F.col(stop)).withColumn("_slice", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    sliced = points.withColumn("_slice", F.floor(F.col(time) / width))
    return sliced.join(cut, [*by, "_slice"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(stop))).drop("_slice")


def overlap_join(left: DataFrame, right: DataFrame, start: str, stop: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals [start, stop) of whole numbers, of equal ``by``, that share a point; columns ``l`` and ``r`` hold the rows.

    Time is cut into slices of ``width``. Of two that overlap, the later start lies within the other interval. So each
    interval goes to the slice of its start, and once to every slice it covers; a start meets the
    intervals that cover its slice, and each pair is met once, where its later start lies (equal starts count for
    the left one), however many slices the two share. Intervals that are empty or lack a bound overlap nothing.
    """
    def sides(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        there = rows.where(F.col(start) < F.col(stop)).select(*(F.col(c).alias(f"_{c}") for c in by), F.struct(*rows.columns).alias(name))
        a, b = F.col(f"{name}.{start}"), F.col(f"{name}.{stop}")
        first = F.floor(a / width)
        return there.withColumn("_slice", first), there.withColumn("_slice", F.explode(F.sequence(first, F.floor((b - 1) / width))))

    l_start, l_cover = sides(left, "l")
    r_start, r_cover = sides(right, "r")
    on = [*(f"_{c}" for c in by), "_slice"]
    a, b = F.col(f"l.{start}"), F.col(f"r.{start}")
    later_right = l_cover.join(r_start, on).where((b > a) & (b < F.col(f"l.{stop}")))
    later_left = l_start.join(r_cover, on).where((a >= b) & (a < F.col(f"r.{stop}")))
    return later_right.select("l", "r").unionByName(later_left.select("l", "r"))


def overlap_totals(intervals: DataFrame, start: str, stop: str, count: str, shared: str) -> DataFrame:
    """Each interval [start, stop) of whole numbers with how many of all ``intervals`` share a point with it, itself included, and
    the sum of the lengths that it shares with them.

    No pairs are made. What overlaps has begun before the stop and not ended by the start, and the lengths shared add up to the
    number of intervals under way, summed over the interval's time. Both follow from running counts and sums over the distinct
    bounds, a prefix scan; an interval looks up its two bounds there. Intervals that are empty or lack a bound are left out.
    """
    whole = intervals.where(F.col(start) < F.col(stop))
    bounds = whole.select(F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("t"), F.lit(k).cast("long").alias("k")) for c, k in ((start, 1), (stop, -1))))).alias("b")).select("b.*")
    # of each bound: what begins and ends there; the moments are counted from the first one, so that sums stay small
    first = bounds.agg(F.min("t")).first()[0] or 0
    at = bounds.groupBy("t").agg(F.count_if(F.col("k") > 0).alias("begun"), F.count_if(F.col("k") < 0).alias("ended"))
    at = at.withColumn("moved", (F.col("begun") - F.col("ended")) * (F.col("t") - first))
    # up to t the time under way is t times the number under way, less the sum of begins and plus that of ends
    upto = running(at, ["t"], {"begins": "begun", "ends": "ended", "moves": "moved"})
    upto = upto.select("t", "ends", (F.col("begins") - F.col("begun")).alias("before"), ((F.col("t") - first) * (F.col("begins") - F.col("ends")) - F.col("moves")).alias("under_way"))
    a, b = (upto.select(F.col("t").alias(f"_{n}"), *(F.col(c).alias(f"_{n}_{c}") for c in columns)) for n, columns in (("a", ("ends", "under_way")), ("b", ("before", "under_way"))))
    found = whole.join(a, F.col(start) == F.col("_a")).join(b, F.col(stop) == F.col("_b"))
    return found.select(*intervals.columns, (F.col("_b_before") - F.col("_a_ends")).alias(count), (F.col("_b_under_way") - F.col("_a_under_way")).alias(shared))


def salted_join(large: DataFrame, small: DataFrame, on: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join in which each hot key of ``large`` is spread over ``salts`` tasks, the rows of ``small`` for it being repeated.

    Hot is a key with more than one row in ``salts``: fewer than ``salts`` keys, whatever the data, so
    they are broadcast; they are found by summaries of fixed size, without an aggregate by key. For joins that adaptive splitting can't help (an aggregate follows on the same
    key). Rows are spread by position, equal ones too; ``large`` must come in an order that a lost
    task's second run repeats, as files and checkpoints do. ``how``: inner, left, left_semi, left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat rows")
    hot = heavy_hitters(large, on, salts).select(*on, F.lit(salts).alias("_salts"))
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    dealt = large.join(F.broadcast(hot), list(on), "left").withColumn("_salt", salt).drop("_salts")
    repeated = small.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of ``left`` whose ``key`` is NOT IN the column ``other`` of ``right``, by SQL's rules for null.

    A null in ``right`` leaves nothing, a null key only stays if ``right`` is empty. Two counts of
    ``right`` decide that, and an anti join the rest, so neither side is broadcast as a null-aware
    anti join must be.
    """
    rows, nulls = right.agg(F.count("*")).scalar(), right.agg(F.count_if(F.col(other).isNull())).scalar()
    keys = right.where(F.col(other).isNotNull()).select(F.col(other).alias("_other")).distinct()
    return left.join(keys, F.col(key) == F.col("_other"), "left_anti").where((rows == 0) | ((nulls == 0) & F.col(key).isNotNull()))


def salted_aggregate(df: DataFrame, by: Sequence[str], salts: int, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Two-step aggregate for functions without a map-side step: by key and salt, then by key."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return dealt.groupBy(*by, "_salt").agg(*(c.alias(n) for n, c in partial.items())).groupBy(*by).agg(*(c.alias(n) for n, c in final.items()))
