import pytest
from pyspark.sql import functions as F

from quern.operators.joins import as_of_join, interval_join, not_in, salted_aggregate, salted_join
from quern.operators.ranking import top_k_per_group
from quern.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_join_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (1, 1, "c"), (2, 9, "d"), (None, 9, "e")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 5, 51), (1, 9, None), (3, 1, 1)], "k int, t int, v int")
    got = {r["x"]: r["v"] for r in as_of_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {"a": None, "b": 51, "c": None, "d": None, "e": None}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join(spark, width):
    points = [(k, t) for k in (1, 2) for t in range(-20, 40, 3)]
    spans = [(1, -5, 6), (1, 0, 30), (2, 7, 7), (2, 9, 8), (2, 12, 13)]
    got = rows(interval_join(spark.createDataFrame(points, "k int, t long"), spark.createDataFrame(spans, "k int, a long, b long"), ["k"], "t", "a", "b", width).select("k", "t", "a"))
    assert got == sorted((k, t, a) for k, t in points for j, a, b in spans if k == j and a <= t < b)


@pytest.mark.parametrize("period", [1, 7, 1000])
def test_as_of_join_by_periods_equals_the_plain_one(spark, period):
    import random

    rng = random.Random(period)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 60), i) for i in range(200)], "k int, t int, x int")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 3, None]), rng.randint(0, 60), rng.choice([None, 1, 2, 3])) for _ in range(60)], "k int, t int, v int")
    plain = as_of_join(left, right, ["k"], "t", "t", ["v"])
    cut = as_of_join(left, right, ["k"], "t", "t", ["v"], lambda t: F.floor(t / period))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, cut.collect())) == sorted(map(key, plain.collect())) and cut.count() == 200


def test_interval_join_without_a_key(spark):
    points = spark.createDataFrame([(x / 4,) for x in range(-40, 40)], "x double")
    spans = spark.createDataFrame([(0, -3.5, 2.25), (1, 1.0, 1.0), (2, 9.0, 30.0), (3, 5.0, 4.0)], "i int, a double, b double")
    got = rows(interval_join(points, spans, [], "x", "a", "b", 3).select("x", "i"))
    assert got == sorted((x / 4, i) for x in range(-40, 40) for i, a, b in [(0, -3.5, 2.25), (2, 9.0, 30.0)] if a <= x / 4 < b)


@pytest.mark.parametrize("left, right, kept", [
    ([1, 2, None], [2, 3], [1]), ([1, 2, None], [2, None], []), ([1, None], [], [1, None]), ([1, None], [None], []), ([], [1], []), ([1, 1, 4], [2, 2], [1, 1, 4]),
])
def test_not_in_follows_sql(spark, left, right, kept):
    a, b = (spark.createDataFrame([(x,) for x in v], f"{c} int") for v, c in ((left, "a"), (right, "b")))
    got = [r[0] for r in not_in(a, "a", b, "b").collect()]
    assert sorted(got, key=str) == sorted(kept, key=str)
    assert sorted((r[0] for r in spark.sql("SELECT a FROM {l} WHERE a NOT IN (SELECT b FROM {r})", l=a, r=b).collect()), key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how):
    large = spark.createDataFrame([(i % 3 if i % 4 else 0, i // 9) for i in range(90)] + [(None, 1), (7, 1)], "k int, x int")
    small = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, y string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(salted_join(large, small, ["k"], 5, how)) == key(large.join(small, ["k"], how))
    with pytest.raises(ValueError):
        salted_join(large, small, ["k"], 5, "full")


def test_salted_join_spreads_equal_rows_of_hot_keys_only(spark):
    large = spark.createDataFrame([(0, 1)] * 300 + [(k, 1) for k in range(1, 50)], "k int, x int").repartition(4)
    small = spark.createDataFrame([(k, "y") for k in range(50)], "k int, y string")
    joined = salted_join(large, small, ["k"], 4)
    assert joined.count() == 349
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = {r["k"]: r["n"] for r in salted_join(large, small, ["k"], 4).withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("p").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts[0] > 1 and all(n == 1 for k, n in parts.items() if k)


def test_user_aggregate_merges_partial_states(spark):
    from quern.functions import user

    df = spark.createDataFrame([(None if i % 5 == 0 else f"g{i % 3}", i % 2, float(i)) for i in range(1, 200)], "g string, h int, x double").repartition(7)
    got = user.aggregate(
        df, ["g", "h"], ["x"], lambda r: (len(r), r["x"].max(), (r["x"] ** 2).sum()), lambda a, b: (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]), lambda s: (int(s[0]), s[1], s[2]), "n long, top double, square double"
    )
    plain = df.groupBy("g", "h").agg(F.count("*").alias("n"), F.max("x").alias("top"), F.sum(F.col("x") * F.col("x")).alias("square"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert user.aggregate(df.where("x < 0"), ["g"], ["x"], lambda r: (0,), lambda a, b: a, lambda s: s, "n double").collect() == []


def test_user_functions(spark):
    from quern.functions import user

    df = spark.createDataFrame([(1, 2.0), (3, None)], "a int, b double")
    assert rows(df.select(user.scalar(lambda a, b: a + b.fillna(0), "double")("a", "b"))) == [(3.0,), (3.0,)]
    with pytest.raises(ValueError):
        user.scalar(lambda a: a, "int")("a", "a", "a")
    spark.udtf.register("quern_test_repeat", user.table_function(lambda n: ((i, i * i) for i in range(n)), "i int, square int"))
    assert rows(spark.sql("SELECT a, i, square FROM {df}, LATERAL quern_test_repeat(a)", df=df)) == [(1, 0, 0), (3, 0, 0), (3, 1, 1), (3, 2, 4)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(str, tables.upsert(old, new, ["k"]).collect())) == sorted(map(str, old.where("k = 1 or k is null").union(new).collect()))


def test_salted_aggregate(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(100)], "k int, x int")
    got = salted_aggregate(df, ["k"], 4, {"s": F.sum("x"), "m": F.max("x")}, {"s": F.sum("s"), "m": F.max("m")})
    assert rows(got) == rows(df.groupBy("k").agg(F.sum("x"), F.max("x")))


def test_top_k_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 5 AS k", "id")
    top = top_k_per_group(df, ["k"], 2, F.desc("id"))
    assert rows(top.select("k", "rank", "id")) == [(k, r, 100 - 5 * r + k) for k in range(5) for r in (1, 2)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i long, s string, x double")
    tables.write(df, str(tmp_path / kind), kind)
    schema = None if kind in tables.SELF_DESCRIBING else df.schema
    assert rows(tables.read(spark, str(tmp_path / kind), kind, schema)) == rows(df)
    if schema is not None:
        with pytest.raises(ValueError):
            tables.read(spark, str(tmp_path / kind), kind)


def test_partitioned_write_prunes(spark, tmp_path):
    tables.write(spark.range(100).selectExpr("id", "id % 3 AS d"), str(tmp_path / "p"), partition_by=("d",))
    got = tables.read(spark, str(tmp_path / "p")).where("d = 1")
    assert got.count() == 33 and "PartitionFilters: [isnotnull(d" in got._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for t in ("quern_a", "quern_b"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
            tables.save_bucketed(spark.range(100).withColumnRenamed("id", "k"), t, ("k",), 4, "overwrite")
        joined = spark.table("quern_a").join(spark.table("quern_b"), "k")
        assert joined.count() == 100 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for t in ("quern_a", "quern_b"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    from quern.plans.queries import queries

    plan = queries()["filter_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan
