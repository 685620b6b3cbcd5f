"""Queries by operators that Spark lacks: scans over whole tables, joins without an equal key, exact statistics, stored sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quern.functions.columns import seconds
from quern.operators.inequality import inequality_aggregate
from quern.operators.joins import overlap_totals, salted_join
from quern.operators.patterns import either, match_rows, repeated, sequence, some
from quern.operators.scans import running
from quern.operators.sketches import merged, per_period
from quern.operators.statistics import exact_percentiles, heavy_hitters
from quern.plans.registry import query
from quern.sources import tables
from quern.sources.shared import fresh_folder

_LINES = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")


def _lines(t) -> DataFrame:
    return t("lineitem").select(*_LINES[:5], "l_linestatus", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


def _lines_sql(partition: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus, row_number() OVER w AS place, CAST(sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far, lag(l_orderkey) OVER w AS before, lag(cents, 3) OVER w AS earlier
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) WINDOW w AS ({partition} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, cents)"""


def _run(t, *by: str) -> DataFrame:
    found = running(_lines(t), _LINES, {"so_far": "cents"}, "place", {"before": ("l_orderkey", 1), "earlier": ("cents", 3)}, by)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "place", "so_far", "before", "earlier")


@query(_lines_sql(""))
def running_over_all(t):
    """Row number, running sum and lags over the whole table, without a task that sees all of it."""
    return _run(t)


@query(_lines_sql("PARTITION BY l_linestatus"))
def running_by_hot_key(t):
    """The same for two keys that hold half of the rows each."""
    return _run(t, "l_linestatus")


_SESSIONS = """SELECT user_id, min(s) AS start, max(s) + 1800 AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s) AS k FROM
  (SELECT user_id, s, CASE WHEN s < lag(s) OVER (PARTITION BY user_id ORDER BY s) + 1800 THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events))) GROUP BY user_id, k"""


@query(f"""WITH x AS ({_SESSIONS}) SELECT a.user_id, a.start, count(*) AS n, CAST(sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS BIGINT) AS shared
  FROM x a JOIN x b ON a.start < b.stop AND b.start < a.stop AND a.user_id <> b.user_id GROUP BY ALL""")
def overlapping_sessions(t):
    """Sessions with those of other users at the same time: intervals against intervals, without an equal key."""
    by_user = Window.partitionBy("user_id").orderBy("s")
    fresh = F.when(F.col("s") < F.lag("s").over(by_user) + 1800, 0).otherwise(1)
    marked = t("events").select("user_id", seconds("ts").alias("s")).withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(by_user))
    sessions = marked.groupBy("user_id", "k").agg(F.min("s").alias("start"), (F.max("s") + 1800).alias("stop")).drop("k")
    # sessions of one user don't overlap, so of those that do only itself is no other user's; null is no user
    totals = overlap_totals(sessions.where("user_id is not null"), "start", "stop", "n", "shared")
    others = totals.select("user_id", "start", (F.col("n") - 1).alias("n"), (F.col("shared") - (F.col("stop") - F.col("start"))).alias("shared"))
    return others.where("n > 0")


@query("""SELECT a.o_orderkey, count(b.o_orderkey) AS n, CAST(coalesce(sum(b.o_custkey), 0) AS BIGINT) AS total
  FROM orders a LEFT JOIN orders b ON a.o_orderdate < b.o_orderdate AND a.o_totalprice >= b.o_totalprice GROUP BY a.o_orderkey""")
def later_and_cheaper(t):
    """Of each order those that came later and cost no more: two inequalities, no equal key."""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", seconds("o_orderdate").alias("day"))
    return inequality_aggregate(orders, orders, ("day", "<", "day"), ("o_totalprice", ">=", "o_totalprice"), "o_orderkey", "o_custkey")


_FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def _percentiles_sql(by: str) -> str:
    listed = ", ".join(map(str, _FRACTIONS))
    return f"""SELECT {by} n, unnest([{listed}]::DOUBLE[]) AS fraction, round(unnest(v), 6) AS value FROM
  (SELECT {by} count(l_extendedprice) AS n, quantile_cont(l_extendedprice, [{listed}]) AS v FROM lineitem {"GROUP BY ALL" if by else ""})"""


@query(_percentiles_sql(""))
def percentiles_of_all(t):
    return exact_percentiles(t("lineitem"), "l_extendedprice", _FRACTIONS).withColumn("value", F.round("value", 6))


@query(_percentiles_sql("l_linestatus,"))
def percentiles_of_hot_keys(t):
    return exact_percentiles(t("lineitem"), "l_extendedprice", _FRACTIONS, ["l_linestatus"]).withColumn("value", F.round("value", 6))


@query("SELECT l_quantity, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) * 100 > (SELECT count(*) FROM lineitem)")
def frequent_quantities(t):
    return heavy_hitters(t("lineitem"), ["l_quantity", "l_linestatus"], 100)


@query("""WITH x AS (SELECT event_type, max(value) AS most, count(*) AS n FROM events GROUP BY event_type)
  SELECT event_id, event_type, most, n FROM events JOIN x USING (event_type)""")
def salted_hot_join(t):
    """A join on a column of a few values, one of which has a large part of the rows: that one is spread over tasks."""
    events = t("events")
    types = events.groupBy("event_type").agg(F.max("value").alias("most"), F.count("*").alias("n"))
    return salted_join(events.select("event_id", "event_type"), types, ["event_type"], 8)


@query("""WITH r AS (SELECT * FROM (VALUES ('first', DATE '2024-01-01', DATE '2024-01-10'), ('middle', DATE '2024-01-08', DATE '2024-01-20'), ('all', DATE '2024-01-01', DATE '2024-02-01')) v(span, since, until)),
  e AS (SELECT span, user_id, value, event_type FROM events JOIN r ON CAST(ts AS DATE) >= since AND CAST(ts AS DATE) < until)
  SELECT span, count(DISTINCT user_id) AS users, CAST(floor(count(DISTINCT user_id) * 0.95) AS BIGINT) AS users_low, CAST(ceil(count(DISTINCT user_id) * 1.05) AS BIGINT) AS users_high, true AS users_near, true AS median_near, true AS both_near FROM e GROUP BY span""")
def sketches_by_day(t):
    """Sketches of each day, stored, merged over spans of days, and compared with the exact values.

    Distinct users by HLL, the median by KLL (its rank within 2 % of one half), users who both clicked and bought by theta sketches.
    """
    spark = t.spark
    events = t("events").select(F.to_date("ts").alias("day"), "user_id", "value", "event_type")
    folder = fresh_folder(spark, "sketches")
    tables.write(per_period(events, ["day"], "user_id", "value", "event_type", ("click", "purchase")), folder)
    stored = tables.read(spark, folder)
    spans = spark.createDataFrame([("first", "2024-01-01", "2024-01-10"), ("middle", "2024-01-08", "2024-01-20"), ("all", "2024-01-01", "2024-02-01")], "span string, since string, until string")
    spans = F.broadcast(spans.select("span", F.to_date("since").alias("since"), F.to_date("until").alias("until")))
    within = (F.col("day") >= F.col("since")) & (F.col("day") < F.col("until"))
    about = merged(stored.join(spans, within), ["span"])
    each = events.join(spans, within)
    of_user = each.groupBy("span", "user_id").agg(F.max((F.col("event_type") == "click").cast("int")).alias("c"), F.max((F.col("event_type") == "purchase").cast("int")).alias("p"))
    users = of_user.groupBy("span").agg(F.count("*").alias("users"), F.sum(F.col("c") * F.col("p")).alias("both"))
    ranks = each.join(F.broadcast(about.select("span", "median")), "span").groupBy("span").agg(F.avg((F.col("value") <= F.col("median")).cast("int")).alias("rank"))
    found = about.join(users, "span").join(ranks, "span")
    return found.select(
        "span", "users", F.floor(F.col("users") * 0.95).alias("users_low"), F.ceil(F.col("users") * 1.05).alias("users_high"),
        F.abs(F.col("about_users") - F.col("users")).__le__(F.col("users") * 0.05).alias("users_near"),
        F.abs(F.col("rank") - 0.5).__le__(0.02).alias("median_near"), F.abs(F.col("about_both") - F.col("both")).__le__(F.col("both") * 0.05 + 2).alias("both_near"),
    )


def _steps(t) -> tuple[DataFrame, dict]:
    events = t("events").select("event_id", "user_id", "event_type", "ts", seconds("ts").alias("s"))
    return events, {name: F.col("event_type") == name for name in ("view", "click", "signup", "purchase")}


@query("""WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s, row_number() OVER w AS rn, count(*) FILTER (event_type IS DISTINCT FROM 'view') OVER (w ROWS UNBOUNDED PRECEDING) AS others,
    lag(event_type) OVER w AS b1, lag(event_type, 2) OVER w AS b2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id))
  SELECT p.user_id, p.event_id, p.rn - min(v.rn) + 1 AS n_rows, arg_min(v.event_id, v.rn) AS first_event, min(v.s) AS started
  FROM e p JOIN e v ON v.user_id IS NOT DISTINCT FROM p.user_id AND v.event_type = 'view' AND v.others = p.others - 2 AND p.s - v.s <= 86400
  WHERE p.event_type = 'purchase' AND p.b1 = 'click' AND p.b2 = 'view' GROUP BY p.user_id, p.event_id, p.rn""")
def purchases_after_views(t):
    """Row pattern by user: views, a click and a purchase within a day, with as many of the views as the day holds."""
    events, conditions = _steps(t)
    pattern = sequence(some("view"), "click", "purchase")
    found = match_rows(events, ["ts", "event_id"], pattern, conditions, ["user_id"], {"first_event": "event_id", "started": "s"}, within=("s", 86400))
    return found.select("user_id", "event_id", "n_rows", "first_event", "started")


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) AS rn FROM events),
  m AS (SELECT *, max(rn) FILTER (event_type IS NULL OR event_type NOT IN ('click', 'signup')) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM e)
  SELECT m.event_id, m.rn - v.rn + 1 AS n_rows, v.event_id AS first_event FROM m JOIN e v ON v.rn = m.at WHERE m.event_type = 'purchase' AND v.event_type = 'view'""")
def shortest_paths_to_purchase(t):
    """Row pattern over all events, without a key: a view, any clicks and signups, a purchase."""
    events, conditions = _steps(t)
    pattern = sequence("view", repeated(either("click", "signup")), "purchase")
    found = match_rows(events, ["ts", "event_id"], pattern, conditions, at_start={"first_event": "event_id"}, longest=False)
    return found.select("event_id", "n_rows", "first_event")
