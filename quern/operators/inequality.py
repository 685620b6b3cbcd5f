"""Joins on two inequalities and no equal key, by strips of quantiles and a wavelet matrix in each."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a strip, both sides together, about, and strips each way at most: then strips grow, and the table of tiles does not.
TILE_ROWS, MAX_SIDE = 1 << 17, 512


def _cuts(quantiles: list[float]) -> np.ndarray:
    """Cuts between strips. A value met by two quantiles or more gets a strip of its own, which can then be told by its cuts."""
    cuts = set(quantiles) | {math.nextafter(c, math.inf) for c, d in zip(quantiles, quantiles[1:]) if c == d}
    return np.array(sorted(cuts))


def _single(cuts: np.ndarray) -> np.ndarray:
    """Of each strip whether it holds one value only."""
    return np.r_[False, np.nextafter(cuts[:-1], np.inf) == cuts[1:], False] if len(cuts) else np.zeros(1, bool)


def _first_beyond(single: np.ndarray, strict: bool) -> np.ndarray:
    """Of each strip the first one that is beyond it as a whole: the next, or a strip of equal values itself if these fulfil the condition."""
    return np.arange(len(single)) + np.where(single & (not strict), 0, 1)


def _beyond(x, y, v, lx, ly, strict_x: bool, strict_y: bool):
    """How many right rows (x, y, v) are beyond each left row (lx, ly) both ways, and the sums of their v.

    The right rows in descending order of x are an array of places in the order of y; a left row asks how many of its
    first ones are at a place or after it. The array is dealt bit by bit, the highest first, and all left rows walk down
    together, adding up the ones where their own bit is zero.
    """
    order = np.argsort(y, kind="stable")
    x, y, v = x[order], y[order], v[order]
    place = np.argsort(-x, kind="stable")
    low, high = np.zeros(len(lx), np.int64), np.searchsorted(-x[place], -lx, "left" if strict_x else "right")
    least = np.searchsorted(y, ly, "right" if strict_y else "left")
    n, total = np.zeros(len(lx), np.int64), np.zeros(len(lx), np.int64)
    for bit in reversed(range(len(y).bit_length())):
        ones = place >> bit & 1
        count, sums = np.r_[0, np.cumsum(ones)], np.r_[0, np.cumsum(np.where(ones, v[place], 0))]
        here = (least >> bit & 1) == 0
        n += np.where(here, count[high] - count[low], 0)
        total += np.where(here, sums[high] - sums[low], 0)
        zeros = len(place) - count[-1]
        low, high = (np.where(here, at - count[at], zeros + count[at]) for at in (low, high))
        place = np.concatenate([place[ones == 0], place[ones == 1]])
    sums = np.r_[0, np.cumsum(v[place])]
    return n + high - low, total + sums[high] - sums[low]


def inequality_aggregate(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], key: str, value: str) -> DataFrame:
    """(key, n, total) of every left row: how many right rows fulfil both conditions, and the sum of their ``value`` (long).

    A condition is (left column, one of < <= > >=, right column), compared as doubles; rows with a null or NaN fulfil none.
    ``key`` tells left rows apart. Left rows without a partner have 0 and 0.

    Both columns are cut into strips by quantiles of both sides. Right rows in a tile that is beyond a left row's both ways count as
    a whole, by the tile's totals. Those of its own strip of the first column are compared in a task that has that strip, and those of its own
    strip of the second, in strips beyond it of the first, in a task that has that one. So a row is sent to two strips at most,
    and a strip of n rows costs n log n. A strip of one value needs no look: its rows fulfil a condition all or none.
    No pairs are written, and no plan has a nested loop. Totals of the tiles (``MAX_SIDE`` squared or so) reach the driver.
    """
    (lx, op_x, rx), (ly, op_y, ry) = first, second
    spark, strict_x, strict_y = left.sparkSession, len(op_x) == 1, len(op_y) == 1

    def side(rows: DataFrame, x: str, y: str, which: int, own_key, own_value) -> DataFrame:
        # a > is a < of the negated columns; adding zero makes a negative zero positive
        columns = (F.col(c).cast("double") * F.lit(-1.0 if op[0] == ">" else 1.0) + 0.0 for c, op in ((x, op_x), (y, op_y)))
        return rows.select(F.lit(which).alias("side"), own_key.alias("key"), *(c.alias(n) for c, n in zip(columns, "xy")), own_value.alias("v"))

    kind = left.schema[key].dataType.simpleString()
    l = side(left, lx, ly, 0, F.col(key), F.lit(0).cast("long"))
    r = side(right, rx, ry, 1, F.lit(None).cast(left.schema[key].dataType), F.coalesce(F.col(value).cast("long"), F.lit(0)))
    there = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    both = l.where(there).unionByName(r.where(there))
    strips = min(MAX_SIDE, max(1, math.ceil(both.count() / TILE_ROWS)))
    shares = [k / strips for k in range(1, strips)]
    quantiles = both.approxQuantile(["x", "y"], shares, 0.25 / strips) if shares else [[], []]
    cuts = [_cuts([float(c) for c in q]) for q in quantiles]
    single = [_single(c) for c in cuts]
    beyond = [_first_beyond(s, strict) for s, strict in zip(single, (strict_x, strict_y))]
    sides = [len(s) for s in single]

    def placed(batches):
        """Each row with its strips, of two values of different strips the smaller in the lower one."""
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            i, j = (np.searchsorted(c, np.asarray(columns[k]), "right").astype(np.int32) for c, k in zip(cuts, (2, 3)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(i), pa.array(j)], ["side", "key", "x", "y", "v", "i", "j"])

    rows = both.mapInArrow(placed, f"side int, key {kind}, x double, y double, v long, i int, j int")
    totals = np.zeros((2, sides[0] + 1, sides[1] + 1), np.int64)
    for t in rows.where("side = 1").groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect():
        totals[:, t["i"], t["j"]] = t["n"], t["v"]
    after = np.flip(np.flip(totals, (1, 2)).cumsum(1).cumsum(2), (1, 2))
    sent = spark.sparkContext.broadcast(after[:, beyond[0][:, None], beyond[1][None, :]])

    def by_tiles(batches):
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            whole = ~(np.isnan(x) | np.isnan(y))
            i, j = (np.searchsorted(c, np.where(whole, a, 0), "right") for c, a in zip(cuts, (x, y)))
            n, total = (np.where(whole, a[i, j], 0) for a in sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array(total)], ["key", "n", "total"])

    # strips of the first column, then of the second
    shared = F.array(*(F.when(~F.element_at(F.lit(s.tolist()), F.col(c) + 1), F.col(c) + base) for s, c, base in zip(single, "ij", (0, sides[0]))))
    dealt = rows.withColumn("strip", F.explode(F.filter(shared, lambda s: s.isNotNull())))
    dealt = dealt.select("strip", "side", "key", "x", "y", "v", "i").repartition("strip").sortWithinPartitions("strip", F.desc("side"))

    def by_strips(batches):
        def compared(strip, parts):
            rows = pa.Table.from_batches(parts)
            there, x, y, v, i = (rows.column(k).to_numpy() for k in (1, 3, 4, 5, 6))
            l, r = there == 0, there == 1
            if not l.any() or not r.any():
                return
            if strip < sides[0]:
                n, total = _beyond(x[r], y[r], v[r], x[l], y[l], strict_x, strict_y)
            else:
                n, total = _beyond(i[r].astype(float), y[r], v[r], beyond[0][i[l]].astype(float), y[l], False, strict_y)
            keys = rows.column(2).combine_chunks().filter(pa.array(l))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(total)], ["key", "n", "total"])

        now, held = None, []
        for batch in batches:
            strip = np.asarray(batch.column(0))
            starts = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]]).tolist() if len(strip) else []
            for a, b in zip(starts, [*starts[1:], len(strip)]):
                if held and strip[a] != now:
                    yield from compared(now, held)
                    held = []
                now = strip[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from compared(now, held)

    found = f"key {kind}, n long, total long"
    counted = l.mapInArrow(by_tiles, found).unionByName(dealt.mapInArrow(by_strips, found))
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumnRenamed("key", key)
