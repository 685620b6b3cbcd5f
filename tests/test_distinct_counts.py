"""The approximate and exact distinct counts: rows of each status and nulls, and what goes through the shuffle."""

import duckdb

from quern.plans import queries


def test_no_sketch_for_each_pair(spark, tmp_path):
    rows = [(s, None if k % 7 == 0 else k % 900) for k in range(4000) for s in ("F", "O", None)] + [("only nulls", None)]
    spark.createDataFrame(rows, "l_linestatus string, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = queries.queries()["approximate_distinct"](spark, str(tmp_path))
    by = lambda r: str(r[0])
    assert sorted(map(tuple, found.collect()), key=by) == sorted(c.sql(queries.oracle_sql()["approximate_distinct"]).fetchall(), key=by)
    aggregates = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in x]
    sketches = [x for x in aggregates if "approx_count_distinct" in x]
    assert sketches and not any("l_partkey" in x.split("functions=")[0] for x in sketches)
