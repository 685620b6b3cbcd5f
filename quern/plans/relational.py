"""The relational queries over the test tables, each as a DataFrame plan and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions.columns import json_text, nearest_second, revenue
from quern.operators.joins import as_of_join, interval_join, not_in, salted_join
from quern.operators.ranking import top_k, top_k_per_group
from quern.plans.registry import query
from quern.streaming.windows import sessions, sliding, tumbling


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    shipped = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(revenue()), 2).alias("sum_revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n")
    )


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
  WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_discount > 0.05""")
def filter_lines(t):
    return t("lineitem").where("l_quantity between 10 and 20 and l_returnflag in ('A', 'R') and l_discount > 0.05").select("l_orderkey", "l_partkey", "l_quantity")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def revenue_by_nation(t):
    orders = t("orders").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", revenue().alias("r"))
    customers = t("customer").select("c_custkey", "c_nationkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


def _order_lines(t, how):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    large = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_quantity") > 45)
    return t("orders").select("o_orderkey", "o_totalprice").join(lines, large, how)


def _order_lines_sql(how):
    return f"""SELECT o_orderkey, o_totalprice, l_orderkey, l_linenumber, l_quantity FROM orders {how} JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45"""


@query(_order_lines_sql("LEFT"))
def left_join(t):
    return _order_lines(t, "left")


@query(_order_lines_sql("RIGHT"))
def right_join(t):
    return _order_lines(t, "right")


@query(_order_lines_sql("FULL"))
def full_join(t):
    return _order_lines(t, "full")


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(t):
    return t("region").select("r_name").crossJoin(t("nation").select("n_name"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.08)")
def semi_join(t):
    return t("orders").join(t("lineitem").where("l_discount > 0.08"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT a.s_suppkey AS rich, b.s_suppkey AS poor FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal")
def theta_join(t):
    a = t("supplier").select(F.col("s_suppkey").alias("rich"), "s_nationkey", F.col("s_acctbal").alias("x"))
    b = t("supplier").select(F.col("s_suppkey").alias("poor"), "s_nationkey", F.col("s_acctbal").alias("y"))
    return a.join(b, "s_nationkey").where("x > y").select("rich", "poor")


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON e.user_id = p.user_id
  AND p.event_type = 'purchase' AND e.event_type = 'click' AND epoch(e.ts)::BIGINT >= epoch(p.ts)::BIGINT - 3600 AND epoch(e.ts)::BIGINT < epoch(p.ts)::BIGINT""")
def clicks_before_purchase(t):
    events = t("events").select("event_id", "user_id", "event_type", nearest_second("ts").alias("s"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "s")
    hours = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", (F.col("s") - 3600).alias("start"), F.col("s").alias("stop"))
    return interval_join(clicks, hours, ["user_id"], "s", "start", "stop", 3600).select("event_id", "purchase_id")


@query("""WITH v AS (SELECT user_id, ts, max(value) AS view_value FROM events WHERE event_type = 'view' GROUP BY ALL)
  SELECT e.event_id, v.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def last_view_at_purchase(t):
    events = t("events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return as_of_join(bought, views, ["user_id"], "ts", "ts", ["view_value"], lambda t: F.to_date(t)).select("event_id", "view_value")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def hot_key_join(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    orders = t("orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return salted_join(lines, orders, ["k"], 4).select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_orderpriority")


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal - 5 AND c_acctbal < s_acctbal + 5""")
def band_join(t):
    bands = t("supplier").select("s_suppkey", (F.col("s_acctbal") - 5).alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return interval_join(t("customer").select("c_custkey", "c_acctbal"), bands, [], "c_acctbal", "low", "high", 10).select("c_custkey", "s_suppkey")


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, l_linestatus FROM lineitem GROUP BY l_linestatus")
def distinct_counts(t):
    return t("lineitem").groupBy("l_linestatus").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


def _grouped(kind):
    return f"""SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::TINYINT AS g1, grouping(o_orderpriority)::TINYINT AS g2, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY {kind}"""


def _levels(grouped):
    return grouped.agg(F.grouping("o_orderstatus").alias("g1"), F.grouping("o_orderpriority").alias("g2"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(_grouped("ROLLUP (o_orderstatus, o_orderpriority)"))
def rollup_orders(t):
    return _levels(t("orders").rollup("o_orderstatus", "o_orderpriority"))


@query(_grouped("CUBE (o_orderstatus, o_orderpriority)"))
def cube_orders(t):
    return _levels(t("orders").cube("o_orderstatus", "o_orderpriority"))


@query(_grouped("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def grouping_sets_orders(t):
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return _levels(t("orders").groupingSets([[a], [b], []], a, b))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("""SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, round(sum(c_acctbal) FILTER (WHERE c_acctbal > 0), 2) AS credit FROM customer GROUP BY c_mktsegment""")
def filtered_aggregates(t):
    return t("customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 2).alias("credit"))


@query("""SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS variance, round(corr(c_acctbal, c_nationkey), 6) AS r, median(c_acctbal) AS mid FROM customer GROUP BY c_mktsegment""")
def statistics(t):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_pop("c_acctbal"), 2).alias("variance"), F.round(F.corr("c_acctbal", "c_nationkey"), 6).alias("r"), F.median("c_acctbal").alias("mid"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest FROM orders GROUP BY o_custkey")
def arg_max(t):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
  FROM orders GROUP BY o_orderpriority""")
def pivot_orders(t):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("SELECT s_suppkey, 'balance' AS field, s_acctbal AS number FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def unpivot_suppliers(t):
    s = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "field", "number")


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS quarter, percent_rank() OVER p AS pr, cume_dist() OVER p AS cd
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def rankings(t):
    w, p = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    long = lambda c: c.cast("long")
    return t("orders").select("o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(p)).alias("rk"), long(F.dense_rank().over(p)).alias("dr"), long(F.ntile(4).over(w)).alias("quarter"), F.percent_rank().over(p).alias("pr"), F.cume_dist().over(p).alias("cd"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER w AS second,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def neighbours(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2).over(w).alias("after"), F.first("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 2).over(w).alias("second"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("recent"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def range_frame(t):
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)
    return t("events").select("event_id", "user_id", nearest_second("ts").alias("s")).select("event_id", F.count("*").over(w).alias("last_day"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def largest_orders(t):
    return top_k(t("orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 20")
def orders_page(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(5).select("o_orderkey")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3""")
def top_orders_per_customer(t):
    return top_k_per_group(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "rank")


def _keys(t):
    key = lambda nation, balance: (F.col(nation) * 1000 + F.floor(F.col(balance) / 250)).cast("long").alias("k")
    return t("customer").select(key("c_nationkey", "c_acctbal")), t("supplier").select(key("s_nationkey", "s_acctbal"))


_A = "SELECT CAST(c_nationkey * 1000 + floor(c_acctbal / 250) AS BIGINT) AS k FROM customer"
_B = "SELECT CAST(s_nationkey * 1000 + floor(s_acctbal / 250) AS BIGINT) AS k FROM supplier"


@query(f"{_A} UNION ALL {_B}")
def union_all(t):
    a, b = _keys(t)
    return a.unionAll(b)


@query(f"{_A} UNION {_B}")
def union_distinct(t):
    a, b = _keys(t)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def intersect_sets(t):
    a, b = _keys(t)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_bags(t):
    a, b = _keys(t)
    return a.intersectAll(b)


@query(f"{_A} EXCEPT {_B}")
def except_sets(t):
    a, b = _keys(t)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def except_bags(t):
    a, b = _keys(t)
    return a.exceptAll(b)


@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substring(p_name, 2, 3) AS sub, replace(p_name, 'a', 'o') AS rep, trim(p_name) AS tr, lpad(p_brand, 12, '*') AS pad,
  reverse(p_brand) AS rev, instr(p_name, 'e') AS at, concat_ws('-', p_brand, p_type) AS both, split_part(p_name, ' ', 1) AS head, p_name LIKE '%a%' AS has_a,
  regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants, md5(p_name) AS digest, levenshtein(p_brand, p_type) AS distance FROM part""")
def string_functions(t):
    n, b = F.col("p_name"), F.col("p_brand")
    return t("part").select(
        "p_partkey", F.upper(n).alias("up"), F.length(n).cast("long").alias("len"), F.substring(n, 2, 3).alias("sub"), F.replace(n, F.lit("a"), F.lit("o")).alias("rep"), F.trim(n).alias("tr"),
        F.lpad(b, 12, "*").alias("pad"), F.reverse(b).alias("rev"), F.instr(n, "e").cast("long").alias("at"), F.concat_ws("-", b, "p_type").alias("both"), F.split_part(n, F.lit(" "), F.lit(1)).alias("head"),
        n.like("%a%").alias("has_a"), F.regexp_replace(n, "[aeiou]", "").alias("consonants"), F.md5(n).alias("digest"), F.levenshtein(b, F.col("p_type")).cast("long").alias("distance"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS month, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days FROM orders""")
def date_functions(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.quarter(d).cast("long").alias("q"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"))


@query("""SELECT p_partkey, abs(p_size - 25) AS away, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, power(p_size, 2) AS square, round(p_retailprice, 1) AS tenth, p_size % 7 AS rest FROM part""")
def math_functions(t):
    x, s = F.col("p_retailprice"), F.col("p_size")
    return t("part").select("p_partkey", F.abs(s - 25).alias("away"), F.ceil(x).alias("up"), F.floor(x).alias("down"), F.round(F.sqrt(x), 6).alias("root"), F.round(F.ln(x), 6).alias("log"), F.pow(s, F.lit(2)).alias("square"), F.round(x, 1).alias("tenth"), (s % 7).alias("rest"))


@query("""SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS head, list_max(embedding)::DOUBLE AS top FROM embeddings""")
def array_functions(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.size(e).cast("long").alias("n"), e[0].cast("double").alias("head"), F.array_max(e).cast("double").alias("top"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word""")
def explode_words(t):
    return t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1""")
def json_fields(t):
    return t("events").groupBy(json_text("props", "k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)")
def above_nation_average(t):
    s = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return s.withColumn("mean", F.avg("s_acctbal").over(Window.partitionBy("s_nationkey"))).where("s_acctbal > mean").select("s_suppkey")


@query("""SELECT time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_windows(t):
    return tumbling(t("events"), "ts", "10 minutes", "event_type")


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') - INTERVAL 10 MINUTES]) AS s FROM events) GROUP BY s""")
def sliding_windows(t):
    return sliding(t("events"), "ts", "20 minutes", "10 minutes")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    return sessions(t("events"), "ts", "30 minutes", "user_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def not_in_large_lines(t):
    large = t("lineitem").where("l_quantity > 45").select("l_orderkey")
    return not_in(t("orders").select("o_orderkey"), "o_orderkey", large, "l_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE nullif(o_custkey % 7, 0) NOT IN (SELECT nullif(s_nationkey, 24) FROM supplier WHERE s_nationkey > 24)""")
def not_in_nothing(t):
    """Nothing is in an empty list, null neither."""
    keys = t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"))
    none = t("supplier").where("s_nationkey > 24").select(F.nullif("s_nationkey", F.lit(24)).cast("long").alias("n"))
    return not_in(keys, "k", none, "n").select("o_orderkey")


@query("""SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS richest FROM nation""")
def scalar_subqueries(t):
    here = F.col("n_nationkey").outer()
    suppliers = t("supplier").where(F.col("s_nationkey") == here).select(F.count("*")).scalar()
    richest = t("customer").where(F.col("c_nationkey") == here).select(F.max("c_acctbal")).scalar()
    return t("nation").select("n_name", suppliers.alias("suppliers"), richest.alias("richest"))


@query("""SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND INTERVAL 1 HOUR FOLLOWING)""")
def interval_frame(t):
    frame = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND INTERVAL 1 HOUR FOLLOWING)"
    return t("events").select("event_id", F.expr(f"count(*) {frame}").alias("n"), F.expr(f"round(sum(value) {frame}, 4)").alias("total"))


@query("""SELECT c_mktsegment, round(skewness(c_acctbal) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) AS skew, round(kurtosis_pop(c_acctbal), 6) AS kurt,
  round(quantile_cont(c_acctbal, 0.1), 4) AS low, round(quantile_cont(c_acctbal, 0.9), 4) AS high, quantile_disc(c_acctbal, 0.25) AS quarter,
  round(covar_pop(c_acctbal, c_nationkey), 4) AS cov, round(regr_slope(c_acctbal, c_nationkey), 6) AS slope, bool_or(c_acctbal < -990) AS any_low, bit_xor(c_custkey) AS parity
  FROM customer GROUP BY c_mktsegment""")
def moments_and_percentiles(t):
    """Skewness is the population's here, DuckDB's the sample's."""
    x, n = F.col("c_acctbal"), F.col("c_nationkey")
    return t("customer").groupBy("c_mktsegment").agg(
        F.round(F.skewness(x), 6).alias("skew"), F.round(F.kurtosis(x), 6).alias("kurt"), F.round(F.percentile(x, F.lit(0.1)), 4).alias("low"), F.round(F.percentile(x, F.lit(0.9)), 4).alias("high"),
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal)").alias("quarter"), F.round(F.covar_pop(x, n), 4).alias("cov"), F.round(F.regr_slope(x, n), 6).alias("slope"),
        F.bool_or(x < -990).alias("any_low"), F.bit_xor("c_custkey").alias("parity"),
    )


_STEPS = """WITH RECURSIVE chain(user_id, event_id, step) AS (
  SELECT user_id, min(event_id), 1 FROM {events} GROUP BY user_id
  UNION ALL
  SELECT chain.user_id, links.next_id, step + 1 FROM chain JOIN {links} links ON chain.event_id = links.event_id WHERE step < 5 AND links.next_id IS NOT NULL)
  SELECT user_id, max(step) AS steps, max(event_id) AS last_event FROM chain GROUP BY user_id"""


@query(_STEPS.format(events="events", links="(SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events)"))
def recursive_chains(t):
    """Each user's first five events, walked from one to the next."""
    events = t("events").select("user_id", "event_id")
    links = events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("next_id"))
    return t.spark.sql(_STEPS, events=events, links=links)


@query("""SELECT p_type, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes FROM part GROUP BY p_type""")
def collected_sets(t):
    return t("part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_size")).cast("array<string>").alias("s")).select("p_type", F.array_join("s", ",").alias("sizes"))


@query("""SELECT l_linestatus, count(DISTINCT l_partkey) AS n, CAST(floor(count(DISTINCT l_partkey) * 0.94) AS BIGINT) AS low, CAST(ceil(count(DISTINCT l_partkey) * 1.06) AS BIGINT) AS high, true AS within
  FROM lineitem GROUP BY l_linestatus""")
def approximate_distinct(t):
    """A sketch, whose value other engines don't share: the exact count, three standard errors about it, and whether the estimate lies within."""
    parts = t("lineitem").select("l_linestatus", "l_partkey")
    # apart from each other: in one aggregate each pair of a status and a part would carry a sketch through the shuffle
    about = parts.groupBy("l_linestatus").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    exact = parts.distinct().groupBy("l_linestatus").agg(F.count("l_partkey").alias("n"))
    counts = exact.alias("e").join(about.alias("a"), F.col("e.l_linestatus").eqNullSafe(F.col("a.l_linestatus"))).select("e.*", "about")
    band = counts.withColumns({"low": F.floor(F.col("n") * 0.94), "high": F.ceil(F.col("n") * 1.06)})
    return band.select("l_linestatus", "n", "low", "high", F.col("about").between(F.col("low"), F.col("high")).alias("within"))
