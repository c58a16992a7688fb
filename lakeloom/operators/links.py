"""Link extraction and ranked resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import is_external, lookup_key, normalize_link

HREF = r'<a [^>]*href="([^"]*)"'


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, target, external) of every link, in text order."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("ordinal", "target"))
    return found.withColumn("external", is_external(F.col("target")))


def resolve(pages: DataFrame) -> DataFrame:
    """Each link's candidates by the first tier with any: whole address, else the same path; 0, 1 or more of them."""
    links = page_links(pages).withColumn("k1", normalize_link(F.col("target"))).withColumn("k2", F.regexp_replace("k1", "^[a-z]+://[^/]*", ""))
    index = pages.select(F.col("page_id").alias("to_page"), normalize_link(F.col("url")).alias("k1")).withColumn("k2", F.regexp_replace("k1", "^[a-z]+://[^/]*", ""))
    whole = index.groupBy("k1").agg(F.count(F.lit(1)).alias("n1"), F.min("to_page").alias("to1"))
    path = index.groupBy("k2").agg(F.count(F.lit(1)).alias("n2"), F.min("to_page").alias("to2"))
    tiers = links.join(whole, "k1", "left").join(path, "k2", "left")
    n = F.coalesce("n1", "n2", F.lit(0))
    state = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return tiers.select("page_id", "ordinal", state.alias("resolution"), F.when(n == 1, F.coalesce("to1", "to2")).alias("to_page"))


def ambiguous_keys(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Lookup keys that several members share."""
    return rows.groupBy(lookup_key(F.col(key)).alias("lookup_key")).agg(F.countDistinct(member).alias("n_members"), F.min(member).alias("least")).where("n_members > 1")
