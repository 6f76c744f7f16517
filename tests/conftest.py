"""A session, the driver's small tables, and comparison of a query with its SQL."""

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Asserts that a query gives the rows of its SQL, whatever their order."""

    def check(query, sql):
        got = query(spark, sf_dir)
        columns = sorted(got.columns)
        told = duck.sql(sql)
        assert columns == sorted(told.columns)
        mine = sorted(tuple(_plain(x) for x in r) for r in got.select(*columns).collect())
        other = sorted(tuple(_plain(x) for x in r) for r in told.select(", ".join(columns)).fetchall())
        assert mine == other

    return check
