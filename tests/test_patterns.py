"""Row patterns against Python's regular expressions over all runs of rows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators.patterns import either, match_rows, maybe, repeated, sequence, some

#: Each row has a letter; a condition is a set of letters, so one row may fulfil several.
SETS = {"a": "a", "b": "b", "ab": "ab", "bc": "bc"}
PATTERNS = {
    "a": ("a", "[a]"),
    "runs": (sequence(some("a"), "b"), "[a]+[b]"),
    "choice": (sequence("ab", repeated(either("bc", sequence("a", "a"))), maybe("a"), "b"), "[ab](?:[bc]|[a][a])*(?:[a])?[b]"),
    "nested": (some(sequence(maybe("a"), some("bc"))), "(?:(?:[a])?[bc]+)+"),
}


def conditions():
    return {name: F.col("letter").isin(*letters) for name, letters in SETS.items()}


def plain(rows, regex, by, longest, limit):
    """rows: (key, order, letter, time). (order of the last row, rows, order of the first row)."""
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        groups[r[0] if by else None].append(r)
    out = set()
    for own in groups.values():
        word = "".join(r[2] or "-" for r in own)
        for j in range(len(own)):
            fits = []
            for i in range(j + 1):
                near = limit is None or (own[i][3] is not None and own[j][3] is not None and own[j][3] - own[i][3] <= limit)
                if near and re.fullmatch(regex, word[i : j + 1]):
                    fits.append(i)
            if fits:
                i = fits[0] if longest else fits[-1]
                out.add((own[j][1], j - i + 1, own[i][1]))
    return out


@pytest.mark.parametrize("longest", [True, False])
@pytest.mark.parametrize("limit", [None, 6])
@pytest.mark.parametrize("name", PATTERNS)
def test_matches(spark, name, limit, longest):
    rng = random.Random(name)
    rows = [(rng.choice([None, "k", "k", "k", f"rare{i % 9}"]), i, rng.choice(["a", "a", "b", "b", "c", "d", None]), None if i % 17 == 3 else i + rng.choice([0, 1])) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, at long, letter string, time long")
    pattern, regex = PATTERNS[name]
    for by, ranges in (([], 13), (["k"], 9)):
        got = match_rows(df, ["at"], pattern, conditions(), by, {"began": "at"}, longest=longest, within=limit and ("time", limit), ranges=ranges)
        found = [(r["at"], r["n_rows"], r["began"]) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == plain(rows, regex, by, longest, limit)


@pytest.mark.parametrize("limit", [None, 9])
def test_matches_over_many_ranges_and_small_batches(spark, limit):
    rows = [("k", i, "a" if i % 30 else "b", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, letter string, time long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for longest in (True, False):
            got = match_rows(df, ["at"], PATTERNS["runs"][0], conditions(), ["k"], {"began": "at"}, longest=longest, within=limit and ("time", limit), ranges=40)
            assert {(r["at"], r["n_rows"], r["began"]) for r in got.collect()} == plain(rows, PATTERNS["runs"][1], True, longest, limit)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_key_is_the_work_of_many_tasks(spark):
    df = spark.range(5000).selectExpr("'hot' AS k", "id AS at", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS letter")
    got = match_rows(df, ["at"], PATTERNS["runs"][0], conditions(), ["k"], ranges=6)
    tasks = got.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == 6 and got.count() == 1667


def test_patterns_that_are_refused_and_nothing_to_match(spark):
    df = spark.createDataFrame([], "k string, at long, letter string, time double")
    assert match_rows(df, ["at"], "a", conditions(), ["k"]).collect() == []
    for pattern in (repeated("a"), sequence(), "unknown"):
        with pytest.raises(ValueError):
            match_rows(df, ["at"], pattern, conditions())
    with pytest.raises(ValueError):
        match_rows(df, ["at"], "a", conditions(), within=("time", 3))
