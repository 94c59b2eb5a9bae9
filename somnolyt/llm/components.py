"""Connected components of links by alternating stars.

Large star: every node links its greater neighbours to the least of its
neighbourhood; small star: every node links its smaller neighbours to the
least of them.  Both are one grouped minimum and one join on the node, repeated
until the links no longer change, which leaves a star per component around its
least node.  Minima are combined before the shuffle and a node with very many
links is split by the adaptive join, so no task has to hold a hub's links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _digest(links: DataFrame) -> tuple:
    """Number of links and an order-free sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    turned = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (turned.unionByName(least.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v")).distinct())


def stars(links: DataFrame) -> DataFrame:
    """(u, v) of every linked node u that is not the least of its component,
    with v the least node.  Nodes are longs; links may repeat or be turned."""
    links = stored(links.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _digest(links)) != before:
        before = now
        links = stored(_small_star(_large_star(links)), "links")
    return links
