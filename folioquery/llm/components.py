"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioquery.llm.common import removed, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return (both.where(F.col("b") > F.col("a")).join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Each row has a > b; a and its lower neighbours are linked to the lowest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    return (links.join(low, "a").where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    ``links`` has two columns of one comparable type. Only minima per node are shuffled and joined back, so a node with
    very many links stays spread out; each round is written to the shared folder. Rounds grow with the logarithm of
    the longest path.
    """
    a, b = links.columns
    now = written(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = None
    while True:
        after = written(_small_star(_large_star(now).distinct()).distinct())
        removed(now)
        now = after
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
