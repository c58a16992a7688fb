import os

import pytest


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Texts with the hard cases: empty, white space, other scripts, junk, ties.
TEXTS = [None, "", " ", "a", "  two  spaces \n\n and\tlines ", "it's we'll don't 'quoted' ''s", "naïve café İstanbul ß ﬁ 漢字かな交じり文 한국어 emoji 👩‍👩‍👧 é", "x" * 700, "ab" * 1200 + " " + "9" * 500, "<|endoftext|> mid<|endoftext|>dle", " nb sp\u0085x", "line\r\nline\r\n\r\n", "A.B,C;D!! ### $$$ a1b2 ½ Ⅷ", "\x00\x1f\x1c control", "word " * 300]


@pytest.fixture()
def hard(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)] + [(3, "a", None, None, None), (None, "null id", "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string, score int")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
