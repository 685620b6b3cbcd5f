"""Queries that write a table in some format and read it again, so that sources and sinks are compared too."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.plans.registry import query
from quern.sources import segments, tables
from quern.sources.shared import fresh_folder


def _again(df: DataFrame, kind: str, partition_by: tuple[str, ...] = (), **options) -> DataFrame:
    """``df`` as read from a folder that it was written to."""
    folder = fresh_folder(df.sparkSession, kind)
    tables.write(df, folder, kind, partition_by, **options)
    return tables.read(df.sparkSession, folder, kind, None if kind in tables.SELF_DESCRIBING else df.schema, **options)


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000"


def _orders(t, kind: str, **options) -> DataFrame:
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return _again(orders, kind, **options).where("o_orderstatus <> 'F' and o_totalprice > 100000")


@query(_ORDERS)
def parquet_format(t):
    return _orders(t, "parquet", compression="zstd")


@query(_ORDERS)
def orc_format(t):
    return _orders(t, "orc")


@query(_ORDERS)
def csv_format(t):
    return _orders(t, "csv", header=True)


@query(_ORDERS)
def json_format(t):
    return _orders(t, "json")


@query("SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '\"' || lang || '\",' || chr(10) || ' ' END FROM documents")
def csv_quoting(t):
    """Whole texts, with what they hold of quotes, commas and line ends, and nulls beside empty texts."""
    odd = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.concat(F.lit('"'), "lang", F.lit('",\n ')))
    docs = t("documents").select("doc_id", "text").unionAll(t("documents").select(-F.col("doc_id") - 1, odd))
    return _again(docs, "csv", multiLine=True, quoteAll=True, escape='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n", maxCharsPerColumn=-1)


@query("SELECT n_regionkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def partitioned_sink(t):
    return _again(t("nation").select("n_name", "n_regionkey"), "parquet", ("n_regionkey",)).where("n_regionkey in (1, 3)").select("n_regionkey", "n_name")


@query("""SELECT r_regionkey, r_name, 'old' AS state FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, upper(r_name) || '!', 'new' FROM region WHERE r_regionkey % 2 = 1""")
def upsert_sink(t):
    """A table overwritten by itself with some rows replaced: the new version is another folder."""
    old = t("region").select("r_regionkey", "r_name", F.lit("old").alias("state"))
    changes = t("region").where("r_regionkey % 2 = 1").select("r_regionkey", F.concat(F.upper("r_name"), F.lit("!")).alias("r_name"), F.lit("new").alias("state"))
    stored = _again(old, "parquet")
    return _again(tables.upsert(stored, changes, ["r_regionkey"]), "parquet")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS o_totalprice FROM orders")
def evolving_schema(t):
    """Files of one folder with further columns in some; older rows have nulls there."""
    folder, orders = fresh_folder(t.spark, "evolving"), t("orders")
    columns = ["o_orderkey", "o_orderstatus"]
    for status, new in (("F", None), ("O", "o_orderpriority"), ("P", "o_totalprice")):
        columns += [new] if new else []
        tables.write(orders.where(F.col("o_orderstatus") == status).select(*columns), folder, mode="append")
    return tables.read(t.spark, folder, mergeSchema=True).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("SELECT event_id, user_id, ts, event_type, value FROM events WHERE event_id >= (SELECT count(*) // 2 FROM events)")
def own_source(t):
    """Events written by ranges of their id to a source of its own, and read with a filter that skips half of the segments."""
    folder, events = fresh_folder(t.spark, "segments"), t("events").select("event_id", "user_id", "ts", "event_type", "value")
    segments.write(events.repartitionByRange(16, "event_id"), folder)
    return segments.read(t.spark, folder).where(F.col("event_id") >= t("events").count() // 2)


@query("SELECT event_id, user_id, value FROM events WHERE event_type <> 'error'")
def own_source_stream(t):
    """The same source at both ends of a stream: one table is read as commits come, another is written batch by batch."""
    folder, events = fresh_folder(t.spark, "segments"), t("events").select("event_id", "user_id", "event_type", "value")
    for k in range(3):
        segments.write(events.where(F.col("event_id") % 3 == k), f"{folder}/in")
    kept = segments.stream(t.spark, f"{folder}/in").where("event_type <> 'error'").select("event_id", "user_id", "value")
    kept.writeStream.format(segments.NAME).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return segments.read(t.spark, f"{folder}/out")
