"""Queries of user-defined functions, maps, JSON and functions of arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.functions import user, variants
from quern.functions.columns import seconds
from quern.plans.registry import query


@query("""SELECT p_partkey, list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda x: CAST(x AS BIGINT)))::BIGINT AS digits FROM part""")
def scalar_udf(t):
    def digit_sum(numbers: pd.Series) -> pd.Series:
        rest, total = numbers.to_numpy(), np.zeros(len(numbers), np.int64)
        while rest.any():
            total, rest = total + rest % 10, rest // 10
        return pd.Series(total)

    return t("part").select("p_partkey", user.scalar(digit_sum, "long")("p_partkey").alias("digits"))


@query("""SELECT p_partkey, p_retailprice - p_size AS rest FROM part WHERE p_retailprice - p_size > 500""")
def scalar_udf_of_two(t):
    less = user.scalar(lambda a, b: a - b, "double")
    return t("part").select("p_partkey", less("p_retailprice", "p_size").alias("rest")).where("rest > 500")


@query("""SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_quantity))), 6) AS geometric, round(count(*) / sum(1 / l_quantity), 6) AS harmonic FROM lineitem GROUP BY ALL""")
def user_aggregate(t):
    def start(rows):
        x = rows["l_quantity"].to_numpy()
        return len(x), float(np.log(x).sum()), float((1 / x).sum())

    return user.aggregate(
        t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], start, lambda a, b: tuple(x + y for x, y in zip(a, b)),
        lambda s: (round(math.exp(s[1] / s[0]), 6), round(s[0] / s[2], 6)), "geometric double, harmonic double",
    )


@query("""SELECT p_partkey, i AS place, array_to_string(w[i:i + 1], ' ') AS gram FROM (SELECT p_partkey, w, unnest(range(1, len(w))) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""")
def table_udf(t):
    def grams(text: str, n: int):
        words = text.split(" ")
        for i in range(len(words) - n + 1):
            yield i + 1, " ".join(words[i : i + n])

    t.spark.udtf.register("quern_word_grams", user.table_function(grams, "place long, gram string"))
    return t.spark.sql("SELECT p_partkey, g.place, g.gram FROM {part}, LATERAL quern_word_grams(p_name, 2) AS g", part=t("part"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""")
def json_to_struct(t):
    parsed = t("events").select("event_id", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", "p.k", F.to_json(F.struct(F.col("event_id").alias("id"), "p.k")).alias("again"))


@query("""SELECT k, count(*) AS n, sum(CAST(v AS BIGINT))::BIGINT AS total FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events) GROUP BY k""")
def json_to_map(t):
    entries = t("events").select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return entries.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total"))


@query("""SELECT p_brand, count(*)::BIGINT AS sizes, sum(n)::BIGINT AS parts, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) FILTER (WHERE n > 1) AS common, max(n) FILTER (WHERE p_size = 7) AS sevens
  FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand""")
def map_functions(t):
    counts = t("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    maps = counts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_size", "n"))).alias("m"))
    several = F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: v > 1)))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return maps.select(
        "p_brand", F.size("m").cast("long").alias("sizes"), total.alias("parts"), F.when(F.size(several) > 0, F.array_join(several.cast("array<string>"), ",")).alias("common"), F.try_element_at("m", F.lit(7)).alias("sevens")
    )


@query("""SELECT r_name, json_object('low', min(n_nationkey), 'high', max(n_nationkey))::VARCHAR AS ends, (max(n_nationkey) * 10)::BIGINT AS high10
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def map_to_json(t):
    ends = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.create_map(F.lit("low"), F.min("n_nationkey"), F.lit("high"), F.max("n_nationkey")).alias("m"))
    tenfold = F.transform_values("m", lambda k, v: (v * 10).cast("long"))
    return ends.select("r_name", F.to_json("m").alias("ends"), tenfold["high"].alias("high10"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS square, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive,
  len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_large, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS top_at, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 6) AS ends FROM embeddings""")
def array_lambdas(t):
    e = F.col("embedding")
    wide = F.transform(e, lambda x: x.cast("double"))
    return t("embeddings").select(
        "vec_id", F.round(F.aggregate(F.zip_with(wide, wide, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6).alias("square"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.exists(e, lambda x: x > 0.3).alias("any_large"), F.array_position(e, F.array_max(e)).alias("top_at"), F.round(F.element_at(wide, 1) + F.element_at(wide, -1), 6).alias("ends"),
    )


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS words, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS backwards,
  list_contains(string_split(p_type, ' '), 'PROMO') AS promo, len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' ')))::BIGINT AS common FROM part""")
def array_sets(t):
    name = F.split("p_name", " ")
    return t("part").select(
        "p_partkey", F.array_join(F.array_sort(F.array_distinct(name)), "|").alias("words"), F.array_join(F.reverse(name), " ").alias("backwards"),
        F.array_contains(F.split("p_type", " "), "PROMO").alias("promo"), F.size(F.array_intersect(name, F.split(F.lower("p_type"), " "))).cast("long").alias("common"),
    )


def _steps_sql(table, key, row, time):
    return f"SELECT '{table}' AS source, {key} AS k, {row} AS row_id, s - lag(s) OVER (PARTITION BY {key} ORDER BY s, {row}) AS step FROM (SELECT {key}, {row}, epoch_us({time}) // 1000000 AS s FROM {table})"


@query(_steps_sql("orders", "o_custkey", "o_orderkey", "o_orderdate") + " UNION ALL " + _steps_sql("events", "user_id", "event_id", "ts"))
def table_argument(t):
    """One table function over two tables of different schemas, each dealt and sorted by its own columns."""
    steps = user.steps_of("s")
    orders = t("orders").select("o_custkey", "o_orderkey", seconds("o_orderdate").alias("s"), "o_orderstatus")
    events = t("events").select(seconds("ts").alias("s"), "event_id", "user_id")
    found = steps(orders.asTable().partitionBy("o_custkey").orderBy("s", "o_orderkey")).select(F.lit("orders").alias("source"), F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("row_id"), "step")
    return found.unionAll(steps(events.asTable().partitionBy("user_id").orderBy("s", "event_id")).select(F.lit("events").alias("source"), F.col("user_id").alias("k"), F.col("event_id").alias("row_id"), "step"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.missing')) AS missing,
  replace(replace(replace(json_group_structure(CAST(props AS JSON))::VARCHAR, '{"k":"UBIGINT"}', 'OBJECT<k: BIGINT>'), ' ', ''), ':B', ': B') AS shape FROM events GROUP BY event_type""")
def variant_props(t):
    """JSON parsed once: typed paths, one that is not there, and the schema that all values share."""
    events = variants.parsed(t("events").select("event_type", "props"), "props", "v")
    typed = variants.shredded(events, "v", {"k": ("$.k", "long"), "missing": ("$.missing", "string")})
    shapes = variants.schema_by(events, "v", ["event_type"])
    return typed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count("missing").alias("missing")).join(shapes, "event_type")


@query("""SELECT key, kind, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type = 'click' THEN ['event', 'k', 'user'] ELSE ['event', 'k'] END) AS key,
  unnest(CASE WHEN event_type = 'click' THEN ['STRING', 'BIGINT', 'BIGINT'] ELSE ['STRING', 'BIGINT'] END) AS kind FROM events) GROUP BY ALL""")
def variant_fields(t):
    """Objects of different fields in one column, taken apart field by field."""
    user_of = F.when(F.col("event_type") == "click", F.col("user_id"))
    made = t("events").select(F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("event"), user_of.alias("user"))).alias("j"))
    found = variants.fields(variants.parsed(made, "j", "v"), "v", [])
    return found.groupBy("key", F.schema_of_variant("value").alias("kind")).agg(F.count("*").alias("n"))
