"""Queries whose SQL rounds time stamps to seconds, on times next to a half second."""

from datetime import datetime, timedelta

import duckdb
import pytest

from quern.plans import queries


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Clicks and purchases an hour or a day apart, but for fractions of a second; even and odd seconds, before 1970 too."""
    folder, rows = tmp_path_factory.mktemp("halves"), []
    for base in (datetime(2024, 1, 1, 12), datetime(1969, 12, 30)):
        for gap in (0, 3600, 86400):
            for second in (0, 1):
                for early in (0, 1, 499_999, 500_000, 500_001, 999_999):
                    for late in (0, 499_999, 500_000, 500_001):
                        user = len(rows) // 2
                        first = base + timedelta(seconds=second, microseconds=early)
                        rows += [(len(rows), first, user, "click", 1.0, "{}"), (len(rows) + 1, base + timedelta(seconds=gap + second, microseconds=late), user, "purchase", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def check(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder)
    rel = c.sql(queries.oracle_sql()[name])
    assert df.columns == rel.columns
    expected = sorted(rel.fetchall())
    assert sorted(map(tuple, df.collect())) == expected and expected


def test_clicks_before_purchase(spark, halves):
    check(spark, halves, "clicks_before_purchase")


def test_range_frame(spark, halves):
    check(spark, halves, "range_frame")
