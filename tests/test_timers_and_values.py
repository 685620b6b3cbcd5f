"""Timers on streams, variants and table functions against plain versions."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.functions import user, variants
from quern.streaming import timers, windows


def test_rows_without_an_answer(spark, tmp_path):
    """Two files, the second with earlier times within the watermark; then a row that lets all timers expire."""
    rng, base = random.Random(3), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i, rng.randint(1, 4), rng.choice(["ask", "answer", "other"]), rng.randint(0, 3000)) for i in range(150)]
    rows += [(900, 1, "ask", 10_000), (901, 1, "answer", 10_060), (902, 2, "ask", 10_000), (903, 2, "answer", 10_061), (904, 3, "ask", 10_000), (905, 3, "answer", 10_000)]
    last = (999, 9, "ask", 50_000)
    schema = "id long, u long, what string, ts timestamp"

    def save(part, name):
        spark.createDataFrame([(i, u, w, base + timedelta(seconds=s)) for i, u, w, s in part], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")

    rng.shuffle(rows)
    save(rows[::2], "in/a")
    save(rows[1::2], "in/b")
    save([last], "in/c")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "5 hours")
    with timers.store(spark):
        windows.run_available(timers.unanswered(stream, "u", "ts", "id", "what", "ask", "answer", 60), f"{tmp_path}/out", f"{tmp_path}/state")
        held = {v: spark.read.format("statestore").option("stateVarName", v).load(f"{tmp_path}/state").count() for v in ("open", "answered")}
    got = {(r["u"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    answers = {(u, s) for _, u, w, s in rows if w == "answer"}
    expected = {(u, i) for i, u, w, s in rows if w == "ask" and not any((u, s + d) in answers for d in range(1, 61))}
    assert got == expected and (1, 900) not in got and {(2, 902), (3, 904)} <= got
    assert held == {"open": 1, "answered": 0}  # the last row alone still waits


def test_variants(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": "1", "c": {"d": [1, 2.5]}}', "[]", "null", "no json", None, "{}"]
    df = variants.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v")
    typed = variants.shredded(df, "v", {"a": ("$.a", "int"), "d": ("$.c.d[1]", "double"), "b": ("$.b", "string")}).orderBy("i").collect()
    assert [(r["a"], r["d"], r["b"]) for r in typed] == [(1, None, "x"), (1, 2.5, None), *[(None, None, None)] * 5]
    keys = variants.fields(df, "v", ["i"]).groupBy("i").agg(F.sort_array(F.collect_list("key")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in keys} == {0: ["a", "b"], 1: ["a", "c"]}
    shapes = {r["i"]: r["shape"] for r in variants.schema_by(df.where("i in (0, 6)"), "v", ["i"]).collect()}
    assert shapes == {0: "OBJECT<a: BIGINT, b: STRING>", 6: "OBJECT<>"}


def test_a_table_function_of_any_table(spark):
    steps = user.steps_of("s", "moved")
    one = spark.createDataFrame([("x", 1, 5), ("x", 2, None), ("x", 3, 9), ("y", 1, 4)], "k string, at int, s long")
    got = {(r["k"], r["at"]): r["moved"] for r in steps(one.asTable().partitionBy("k").orderBy("at")).collect()}
    assert got == {("x", 1): None, ("x", 2): None, ("x", 3): 4, ("y", 1): None}
    other = spark.createDataFrame([(3, 7.5), (1, 0.5)], "s long, extra double")
    found = steps(other.asTable().withSinglePartition().orderBy("s"))
    assert found.columns == ["s", "extra", "moved"] and [r["moved"] for r in found.orderBy("s").collect()] == [None, 2]
    with pytest.raises(Exception, match="the column s is needed"):
        steps(other.select("extra").asTable()).collect()
