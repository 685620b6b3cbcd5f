"""Counts and shared lengths of overlapping intervals against plain loops, and sessions against the SQL, without pairs."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from quern.operators.joins import overlap_totals
from quern.plans import queries


@pytest.mark.parametrize("base", [0, -(2**40)])
def test_overlap_totals(spark, base):
    rng = random.Random(base)
    rows = [(i, base + s, base + s + rng.choice([-1, 0, 1, 2, 5, 60])) for i, s in enumerate(rng.randint(-50, 50) for _ in range(150))] + [(900, None, 4), (901, 4, None)]
    got = overlap_totals(spark.createDataFrame(rows, "id long, a long, b long"), "a", "b", "n", "shared").collect()
    whole = [r for r in rows if r[1] is not None and r[2] is not None and r[1] < r[2]]
    expected = []
    for i, a, b in whole:
        met = [min(b, d) - max(a, c) for _, c, d in whole if a < d and c < b]
        expected.append((i, a, b, len(met), sum(met)))
    assert sorted(map(tuple, got)) == expected
    assert overlap_totals(spark.createDataFrame([], "id long, a long, b long"), "a", "b", "n", "shared").collect() == []


def test_overlapping_sessions_make_no_pairs(spark, tmp_path):
    """Sessions that all overlap: the plan has no join but those that look up bounds; nulls are no user and no time."""
    rng, base = random.Random(4), datetime(2024, 1, 1)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *(base + timedelta(seconds=rng.randint(0, 9000), microseconds=rng.randint(0, 999_999)) for _ in range(30))])) for _ in range(600)]
    rows += [(50, base + timedelta(days=9)), (51, base + timedelta(days=9, seconds=1800)), (51, base + timedelta(days=9, seconds=3599)), (51, base + timedelta(days=9, seconds=5399))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = queries.queries()["overlapping_sessions"](spark, str(tmp_path))
    expected = sorted(c.sql(queries.oracle_sql()["overlapping_sessions"]).fetchall())
    assert sorted(map(tuple, found.collect())) == expected and max(r[2] for r in expected) > 30
    assert "_slice" not in found._jdf.queryExecution().optimizedPlan().toString()
