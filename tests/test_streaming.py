from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.sources.tables import load
from quern.streaming import state, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_up_to_the_watermark(spark, sf_dir, tmp_path):
    events = windows.with_event_time(windows.stream(spark, sf_dir, "events"), "ts", "10 minutes")
    windows.run_available(windows.tumbling(events, "ts", "10 minutes", "event_type"), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = batch.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    expected = windows.tumbling(batch, "ts", "10 minutes", "event_type").where(F.col("start") + F.expr("INTERVAL 10 MINUTES") <= F.lit(last))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(expected)
    # nothing new: a second run from the same checkpoint adds nothing
    events = windows.with_event_time(windows.stream(spark, sf_dir, "events"), "ts", "10 minutes")
    windows.run_available(windows.tumbling(events, "ts", "10 minutes", "event_type"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(expected)


def test_late_rows_and_repeats(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "id long, ts timestamp_ntz"
    source = tmp_path / "events.parquet"
    for k, part in enumerate([[(1, at), (1, at), (2, at + timedelta(hours=3))], [(3, at + timedelta(minutes=1)), (4, at + timedelta(hours=4))], [(4, at + timedelta(hours=4))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    events = windows.with_event_time(windows.stream(spark, str(tmp_path), "events", 1), "ts", "10 minutes")
    windows.run_available(windows.first_seen(events, "id"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and {1, 2, 4} <= set(got)


def test_sessions_stream(spark, sf_dir, tmp_path):
    events = windows.with_event_time(windows.stream(spark, sf_dir, "events"), "ts", "1 minute")
    windows.run_available(windows.sessions(events, "ts", "30 minutes", "user_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = rows(windows.sessions(batch, "ts", "30 minutes", "user_id"))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert set(got) <= set(expected) and len(got) >= len(expected) - 20


def test_running_totals_go_on_from_batch_to_batch(spark, tmp_path):
    source = tmp_path / "events.parquet"
    for part in ([("a", 1.0), ("b", 2.0), ("a", 3.0)], [("a", 5.0)], [("c", 1.0), ("b", 1.0)]):
        spark.createDataFrame(part, "u string, v double").coalesce(1).write.mode("append").parquet(str(source))
    totals = state.running_totals(windows.stream(spark, str(tmp_path), "events", 1), "u", "v")
    windows.run_available(totals, str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(state.latest(out, "u", "n").select("u", "n", "total")) == [("a", 3, 9.0), ("b", 2, 3.0), ("c", 1, 1.0)]
    assert out.count() == 5  # a row for each key of each batch
    # a second run from the same checkpoint goes on with the state
    spark.createDataFrame([("c", 4.0)], "u string, v double").coalesce(1).write.mode("append").parquet(str(source))
    windows.run_available(state.running_totals(windows.stream(spark, str(tmp_path), "events", 1), "u", "v"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(state.latest(spark.read.parquet(str(tmp_path / "out")), "u", "n").select("u", "n", "total"))[2] == ("c", 2, 5.0)


def test_streams_join_across_batches(spark, tmp_path):
    at = datetime(2024, 1, 1)
    minutes = lambda n: at + timedelta(minutes=n)
    parts = [[(1, "click", minutes(0)), (2, "click", minutes(30))], [(1, "purchase", minutes(40))], [(2, "purchase", minutes(95)), (1, "click", minutes(96))]]
    for part in parts:
        spark.createDataFrame(part, "u int, kind string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    side = lambda kind, t: windows.with_event_time(windows.stream(spark, str(tmp_path), "events", 1), "ts", "2 hours").where(f"kind = '{kind}'").select("u", F.col("ts").alias(t))
    windows.run_available(state.joined_within(side("click", "c"), side("purchase", "p"), ["u"], "c", "p", "1 HOUR").select("c", "p"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert [(c.hour * 60 + c.minute, p.hour * 60 + p.minute) for c, p in got] == [(0, 40)]
