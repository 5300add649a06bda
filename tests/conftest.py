import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def duck(sf=SF):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(df):
    import pandas as pd

    out = []
    names = sorted(df.columns)
    for r in df[names].itertuples(index=False):
        out.append(repr(tuple(None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else x.item() if hasattr(x, "item") else x for x in r)))
    return sorted(out)


def same(spark, query, sql, sf=SF):
    left, right = query(spark, sf).toPandas(), duck(sf).execute(sql).df()
    assert sorted(left.columns) == sorted(right.columns)
    assert rows(left) == rows(right)
