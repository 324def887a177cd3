"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomweb.llm.shared import checkpointed


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def connected(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """node, root (the smallest node its links reach) for every node with a link to another.

    Each step joins links to one minimum for each node and keeps distinct links, so a node with
    very many neighbours is never gathered in one place.
    """
    now = checkpointed(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    sum_of = lambda df: df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while (seen := sum_of(now)) != before:
        before = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpointed(_least(both).withColumn("low", F.least("a", "low")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = checkpointed(large)
        small_low = checkpointed(_least(large))
        moved = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        now = checkpointed(moved.unionByName(small_low.select("a", F.col("low").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
