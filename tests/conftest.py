import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    from decimal import Decimal

    return f"{float(v):.6f}" if isinstance(v, (float, Decimal)) else str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame has the columns and, in any order, the rows of a DuckDB query."""

    def check(df, sql):
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        columns = sorted(df.columns)
        at = [rel.columns.index(c) for c in columns]
        expected = sorted([_plain(r[i]) for i in at] for r in rel.fetchall())
        assert sorted([_plain(v) for v in r] for r in df.select(columns).collect()) == expected

    return check
