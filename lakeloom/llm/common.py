"""Shared pieces: input preparation, and the library's code shipping and shared folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import drop, scratch, shared_dir, ship, staged

__all__ = ["SPACES", "WORD", "WORD_CLASS", "doc_text", "drop", "input_bytes", "scratch", "shared_dir", "ship", "staged", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that a plan reads; of a plan of unknown size, 16 MiB for each partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else df.rdd.getNumPartitions() << 24


WORD_CLASS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_CLASS)
#: The six separators of WORD_CLASS.
SPACES = " \t\n\x0b\f\r"
