"""Scans over whole tables, joins without equal keys and exact statistics against plain versions."""

import math
import operator
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import inequality, statistics
from quern.operators.joins import overlap_join, salted_join
from quern.operators.scans import running
from quern.operators.sketches import merged, per_period


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_running(rows, by):
    """rows: (key, order, value, word); values before each of them in order, within the key or over all."""
    out, state = [], defaultdict(list)
    for r in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or "") if by else (), r[1] is not None, r[1] or 0)):
        own = state[r[0] if by else None]
        own.append(r)
        there = [x[2] for x in own if x[2] is not None]
        out.append((*r, len(own), sum(there) if there else None, own[-2][3] if len(own) > 1 else None, own[-4][2] if len(own) > 3 else None))
    return out


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_running(spark, by, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([None, "a", "a", "a", "a", "b", "c", f"rare{i % 17}"]), i, rng.choice([None, -(2**40), 3, 7]), rng.choice([None, "x", "é"])) for i in range(400)]
    rows += [("a", None, 5, "first"), ("only nulls", 900, None, None), ("only nulls", 901, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long, word string")
    got = running(df, ["at"], {"total": "v"}, "n", {"word_before": ("word", 1), "v_before": ("v", 3)}, by, ranges)
    assert "SinglePartition" not in plan(got)
    assert Counter(map(tuple, got.drop("_range").collect())) == Counter(plain_running(rows, by))


def test_running_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k, i, i, str(i)) for i, k in enumerate("aaaaaaaaabbaaaacccccccccccccc" * 3)]
        got = running(spark.createDataFrame(rows, "k string, at long, v long, word string"), ["at"], {"total": "v"}, "n", {"word_before": ("word", 1), "v_before": ("v", 3)}, ["k"], 5)
        assert Counter(map(tuple, got.collect())) == Counter(plain_running(rows, ["k"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_of_nothing_and_of_fractions(spark):
    none = spark.createDataFrame([], "k string, at long, v long, word string")
    assert running(none, ["at"], {"total": "v"}, "n", {"before": ("word", 1)}).collect() == []
    with pytest.raises(ValueError):
        running(spark.createDataFrame([(1, 0.5)], "at long, v double"), ["at"], {"total": "v"})


@pytest.mark.parametrize("width", [1, 5, 1000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_overlaps(spark, width, by):
    rng = random.Random(width)

    def intervals(n):
        starts = [rng.randint(-50, 50) for _ in range(n)]
        return [(i, rng.choice([None, "x", "y"]), s, s + rng.choice([-1, 0, 1, 2, 5, 60])) for i, s in enumerate(starts)] + [(n, "x", None, 4), (n + 1, "x", 4, None)]

    left, right = intervals(60), intervals(50)
    l, r = (spark.createDataFrame(x, "id long, g string, a long, b long") for x in (left, right))
    got = overlap_join(l, r, "a", "b", width, by).select("l.id", F.col("r.id").alias("other")).collect()
    whole = lambda x: x[2] is not None and x[3] is not None and x[2] < x[3]
    expected = [(x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[2] < y[3] and y[2] < x[3] and (not by or x[1] == y[1] is not None)]
    assert Counter(map(tuple, got)) == Counter(expected)


OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.mark.parametrize("tile", [8192, 30])
@pytest.mark.parametrize("x, y", [("<", ">="), ("<=", "<"), (">", ">"), (">=", "<=")])
def test_inequalities(spark, monkeypatch, tile, x, y):
    monkeypatch.setattr(inequality, "TILE_ROWS", tile)
    rng = random.Random(x + y)
    number = lambda: rng.choice([None, float("nan"), *(float(rng.randint(-20, 20)) for _ in range(20))])
    left = [(i, number(), number()) for i in range(150)]
    right = [(number(), number(), rng.choice([None, 1, 2**40, -7])) for _ in range(400)]
    l, r = spark.createDataFrame(left, "id long, a double, b double"), spark.createDataFrame(right, "c double, d double, v long")
    found = inequality.inequality_aggregate(l, r, ("a", x, "c"), ("b", y, "d"), "id", "v")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    there = lambda v: v is not None and not math.isnan(v)
    expected = set()
    for i, a, b in left:
        met = [v or 0 for c, d, v in right if there(a) and there(b) and there(c) and there(d) and OPS[x](a, c) and OPS[y](b, d)]
        expected.add((i, len(met), sum(met)))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(left) and set(got) == expected


def test_inequalities_of_nothing(spark):
    l, r = spark.createDataFrame([(1, 1.0, 1.0)], "id long, a double, b double"), spark.createDataFrame([], "c double, d double, v long")
    args = (("a", "<", "c"), ("b", "<", "d"), "id", "v")
    assert [tuple(x) for x in inequality.inequality_aggregate(l, r, *args).collect()] == [(1, 0, 0)]
    assert inequality.inequality_aggregate(l.where("id > 1"), r, *args).collect() == []


@pytest.mark.parametrize("bins", [512, 2])
def test_percentiles(spark, monkeypatch, bins):
    monkeypatch.setattr(statistics, "BINS", bins)
    rng = random.Random(bins)
    values = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [1.5] * 40 + [2.0], None: [-1e300, 1e300, 0.0, 1e-300], "c": [7.0], "d": [float(i % 3) for i in range(99)]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("a", None), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    fractions = [0.0, 0.1, 0.5, 0.975, 1.0]
    got = {(r["k"], r["fraction"]): (r["n"], r["value"]) for r in statistics.exact_percentiles(df, "v", fractions, ["k"]).collect()}
    assert got.keys() == {(k, f) for k in values for f in fractions}
    for k, own in values.items():
        for f in fractions:
            assert got[k, f][0] == len(own) and got[k, f][1] == pytest.approx(float(np.percentile(own, 100 * f)), rel=1e-12)
    everything = [v for own in values.values() for v in own]
    whole = {r["fraction"]: r["value"] for r in statistics.exact_percentiles(df, "v", fractions).collect()}
    assert whole == pytest.approx({f: float(np.percentile(everything, 100 * f)) for f in fractions}, rel=1e-12)
    assert statistics.exact_percentiles(df.where("k = 'e'"), "v", fractions).collect() == []


@pytest.mark.parametrize("k", [2, 7, 100])
def test_heavy_hitters(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice(["a", "a", "a", None, "b", f"rare{rng.randint(0, 3000)}"]), rng.choice([1, 2])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "x string, y int").repartition(6)
    expected = {(*key, n) for key, n in Counter(rows).items() if n * k > len(rows)}
    got = [tuple(r) for r in statistics.heavy_hitters(df, ["x", "y"], k).collect()]
    assert len(got) == len(expected) and set(got) == expected and (expected or k == 2)
    assert statistics.heavy_hitters(df.where("y > 2"), ["x", "y"], k).collect() == []


def test_salted_join_spreads_the_hot_key(spark):
    large = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(400)], "k string, i long").repartition(4)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, w int")
    got = Counter(map(tuple, salted_join(large, small, ["k"], 4).collect()))
    assert got == Counter(map(tuple, large.join(small, "k").collect())) and sum(got.values()) == 401
    assert statistics.heavy_hitters(large, ["k"], 4).collect()[0]["k"] == "hot"


def test_sketches_merge_over_periods(spark):
    rows = spark.range(60_000).selectExpr("id % 10 AS day", "id % 7001 AS member", "CAST(id % 1000 AS double) AS v", "CASE WHEN id % 3 = 0 THEN 'one' ELSE 'two' END AS kind")
    stored = per_period(rows, ["day"], "member", "v", "kind", ("one", "two"))
    found = merged(stored.where("day < 5").withColumn("span", F.lit("x")), ["span"]).first()
    exact = rows.where("day < 5")
    n = exact.select("member").distinct().count()
    both = exact.groupBy("member").agg(F.countDistinct("kind").alias("c")).where("c = 2").count()
    assert abs(found["about_users"] - n) <= 0.05 * n and abs(found["about_both"] - both) <= 0.06 * both and abs(found["median"] - exact.approxQuantile("v", [0.5], 0.0)[0]) <= 20
