import os
import sys
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def rows(df) -> list[tuple]:
    """The rows of a pandas frame in one order, columns by name, numbers to nine digits."""
    df = df[sorted(df.columns)]
    out = [tuple(None if x is None or x is pd.NA or x != x else f"{float(x):.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)]
    return sorted(out, key=repr)
