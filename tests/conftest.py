from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def same_rows(df, result) -> None:
    """A Spark result and DuckDB's, as bags of rows with the same columns."""
    cols = sorted(df.columns)
    assert cols == sorted(result.columns)
    at = [result.columns.index(c) for c in cols]
    ours = sorted(repr([_plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = sorted(repr([_plain(r[i]) for i in at]) for r in result.fetchall())
    assert ours == theirs
