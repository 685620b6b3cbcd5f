"""The data source of Arrow segments: both phases of a write, pruning, and streams at both ends."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.sources import segments


def files(folder):
    return sorted(p.name for p in Path(folder, "data").glob("*.arrow"))


def rows(spark, n=1000):
    return spark.range(n).selectExpr("id", "CAST(id AS string) AS s", "CASE WHEN id % 3 = 0 THEN id / 2 END AS d", "timestamp_seconds(id) AS ts", "array(id) AS a")


def test_written_and_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    segments.write(rows(spark).repartition(5), folder)
    got = segments.read(spark, folder)
    assert got.schema.simpleString() == rows(spark).schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows(spark).collect()))
    segments.write(rows(spark, 10), f"file:{folder}")  # Hadoop's spelling of a local path
    assert segments.read(spark, folder).count() == 1010
    segments.write(rows(spark, 7), folder, "overwrite")
    assert segments.read(spark, folder).count() == 7
    segments.write(rows(spark, 7).where("id > 100"), folder)
    assert segments.read(spark, folder).count() == 7
    with pytest.raises(Exception, match="no table"):
        segments.read(spark, str(tmp_path / "none"))


def test_pushed_filters_skip_segments(spark, tmp_path):
    folder = str(tmp_path / "t")
    segments.write(rows(spark).repartitionByRange(10, "id"), folder)
    table = segments.read(spark, folder)
    for condition, most in ((F.col("id") >= 900, 2), (F.col("id") == 5, 1), (F.col("id") < 0, 1), ((F.col("id") > 150) & (F.col("id") <= 250), 3), (F.col("s") == "x", 1), (F.col("d") > 450.0, 2)):
        found = table.where(condition)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows(spark).where(condition).collect()))
        assert found.rdd.getNumPartitions() <= most, condition
    assert table.where("id % 2 = 0").rdd.getNumPartitions() == len(files(folder)) == 10
    # what one query pushed is no other's
    assert [table.where("id >= 900").count(), table.count(), table.where("id % 2 = 0").count(), table.where("id < 5").count(), table.count()] == [100, 1000, 500, 5, 1000]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    segments.write(rows(spark, 100), folder)
    before = files(folder)

    def breaks(batches):
        for batch in batches:
            yield batch
            if batch["id"].iloc[0] >= 700:
                raise RuntimeError("killed")

    broken = rows(spark).select("id", "s").repartitionByRange(4, "id").mapInPandas(breaks, "id long, s string")
    with pytest.raises(Exception):
        segments.write(broken.selectExpr("id", "s", "CAST(NULL AS double) AS d", "CAST(NULL AS timestamp) AS ts", "array(id) AS a"), folder)
    assert segments.read(spark, folder).count() == 100 and len(list(Path(folder, "log").glob("*.json"))) == 1
    assert files(folder) == before


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = segments.stream(spark, source).where("id % 2 = 0").select("id", "s")
        stream.writeStream.format(segments.NAME).option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    segments.write(rows(spark, 50), source)
    run()
    segments.write(rows(spark, 80).where("id >= 50"), source)
    run()
    run()
    assert sorted(r["id"] for r in segments.read(spark, out).collect()) == list(range(0, 80, 2))
