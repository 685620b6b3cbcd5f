"""Streaming queries: each reads a table as a stream, runs over all there is into a folder, and reads that."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions.columns import seconds
from quern.plans.registry import query
from quern.sources.shared import fresh_folder
from quern.streaming import state, timers, windows


def _written(df: DataFrame) -> DataFrame:
    folder = fresh_folder(df.sparkSession, "stream")
    windows.run_available(df, f"{folder}/out", f"{folder}/state")
    return df.sparkSession.read.parquet(f"{folder}/out")


def _events(t, late: str = "10 minutes") -> DataFrame:
    return windows.with_event_time(windows.stream(t.spark, t.folder, "events"), "ts", late)


_PASSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


@query(f"""SELECT epoch(start)::BIGINT AS start, event_type, n FROM (SELECT time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
  WHERE start + INTERVAL 10 MINUTES <= {_PASSED}""")
def stream_tumbling(t):
    """Windows that the watermark has passed; the last ones stay in the state."""
    return _written(windows.tumbling(_events(t), "ts", "10 minutes", "event_type")).withColumn("start", F.col("start").cast("long"))


@query(f"""SELECT epoch(start)::BIGINT AS start, n FROM (SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01'),
  time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') - INTERVAL 10 MINUTES]) AS s FROM events) GROUP BY s) WHERE start + INTERVAL 20 MINUTES <= {_PASSED}""")
def stream_sliding(t):
    return _written(windows.sliding(_events(t), "ts", "20 minutes", "10 minutes")).withColumn("start", F.col("start").cast("long"))


@query(f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
  SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= {_PASSED}""")
def stream_sessions(t):
    done = _written(windows.sessions(_events(t), "ts", "30 minutes", "user_id"))
    return done.select("user_id", F.col("start").cast("long").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(t):
    """Repeats within the watermark are dropped in the stream, those further apart in what it has written."""
    return _written(windows.first_seen(_events(t, "1 day").select("user_id", "event_type", "ts"), "user_id", "event_type")).select("user_id", "event_type").distinct()


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(t):
    totals = _written(state.running_totals(windows.stream(t.spark, t.folder, "events"), "user_id", "value"))
    return state.latest(totals, "user_id", "n").select("user_id", "n", F.round("total", 4).alias("total"))


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id, epoch_us(p.ts) // 1000000 AS at FROM events c JOIN events p ON c.user_id = p.user_id
  AND c.event_type = 'click' AND p.event_type = 'purchase' AND c.ts >= p.ts - INTERVAL 1 HOUR AND c.ts < p.ts""")
def stream_join(t):
    clicks = _events(t).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    bought = _events(t).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"))
    pairs = state.joined_within(clicks, bought, ["user_id"], "clicked", "bought", "1 HOUR")
    return _written(pairs.select("click_id", "purchase_id", "bought")).select("click_id", "purchase_id", seconds("bought").alias("at"))


@query("""SELECT e.event_id, c_mktsegment FROM events e JOIN customer ON e.user_id = c_custkey WHERE e.event_type = 'purchase'""")
def stream_static_join(t):
    """A stream against a table: each batch is joined by a plain equi-join, without state."""
    bought = windows.stream(t.spark, t.folder, "events").where("event_type = 'purchase'").select("event_id", "user_id")
    customers = t("customer").select("c_custkey", "c_mktsegment")
    return _written(bought.join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"))


@query("""SELECT user_id, event_id, epoch_us(ts) AS at FROM events c WHERE event_type = 'click' AND ts + INTERVAL 1 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTES FROM events WHERE event_type IN ('click', 'purchase'))
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR)""")
def stream_timers(t):
    """Clicks that no purchase followed within an hour, told by a timer once the watermark has passed that hour."""
    wanted = _events(t).where("event_type in ('click', 'purchase')")
    with timers.store(t.spark):
        return _written(timers.unanswered(wanted, "user_id", "ts", "event_id", "event_type", "click", "purchase", 3600))
