"""Every query against its DuckDB SQL."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest
from pyspark.sql import SparkSession

from lakeloom import catalog, note_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, db):
    df = catalog.QUERIES[name](spark, SF)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if sql := catalog.ORACLES.get(name):
        found = db.sql(sql)
        assert sorted(found.columns) == sorted(df.columns)
        at = [found.columns.index(c) for c in sorted(found.columns)]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
