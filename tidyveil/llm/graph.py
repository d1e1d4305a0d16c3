"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """One round of alternating stars: larger neighbours, then smaller ones, are linked to the least one.

    Links are kept as (a, b) with a > b; both halves keep components as they are and shorten paths.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
    small = large.join(lowest, F.col("a") == F.col("of")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(lowest.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``links`` (columns a, b of bigint) but the roots.

    Every round is stored, so the plan stays short and a lost executor costs one round. The driver sees two sums a round.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sums = F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) AS decimal(20)))")
    before = now.agg(*sums).first()
    while before[0]:
        now = stored(_stars(now), "links")
        after = now.agg(*sums).first()
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
