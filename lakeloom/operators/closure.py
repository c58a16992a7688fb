"""Constraint queries: coverage, set equality, anti-joins, range membership, and differences of inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coverage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents are covered never, once or more often, and how many labels have no document."""
    a = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_docs"))
    b = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_labels"))
    both = a.join(b, "doc_id", "full_outer")
    state = F.when(F.col("n_docs").isNull(), "unknown").when(F.col("n_labels").isNull(), "uncovered").when(F.col("n_labels") == 1, "once").otherwise("repeated")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def uncovered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "source")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks (with multiplicity), marked by side: empty if they are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def section_blocks(blocks: DataFrame, group: str, place: str, is_heading) -> DataFrame:
    """Blocks by section: a section runs from its heading to the next; a running maximum does the
    range join (blocks of one place belong together)."""
    w = W.partitionBy(group).orderBy(place).rangeBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("section", F.max(F.when(is_heading, F.col(place))).over(w))


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and changed keys."""
    a, b = before.select(key, F.col(value).alias("a")), after.select(key, F.col(value).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key, state.alias("state"))
